"""Adapter views: the given tables seen as assets, pages, records and results.

Each view is written once, as SQL that Spark and DuckDB both run.  ``{name}``
stands for a table or another view, ``@NS@`` for the token namespace.  Modulo
expressions only vary values; no view leaves rows of its tables out.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from shelfmark.fixed_values import TOKEN_NAMESPACE

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)

VIEWS = {
    # One asset per document; names repeat across folders, paths do not.
    "v_assets": """
        SELECT doc_id, text, lang, source, n_chars AS size, doc_id * 60 AS mtime,
               folder, stem, folder || '/' || stem || '.tif' AS path
        FROM (SELECT *,
                '/lib/' || source
                || CASE doc_id % 3 WHEN 0 THEN '/_EXPORT' WHEN 1 THEN '/Lightroom_Export'
                   ELSE '/raw' END
                || '/r' || CAST(CAST(floor(doc_id / 40) AS INT) AS STRING) || '/' || lang AS folder,
                'DSC_' || lpad(CAST(doc_id % 40 AS STRING), 4, '0') AS stem
              FROM {documents}) named""",
    # The outputs that exist already: those of labelled documents.
    "v_existing": """
        SELECT a.doc_id, a.path, a.folder || '/JXL_16bits/' || a.stem || '.jxl' AS dest,
               CASE WHEN l.quality = 1 THEN a.mtime + 30 ELSE a.mtime - 30 END AS out_mtime,
               CASE WHEN l.toxic = 1 THEN '/moved' || a.path WHEN a.lang = 'es' THEN NULL
                    ELSE a.path END AS rec_path,
               CASE WHEN a.lang = 'es' THEN NULL WHEN a.lang = 'de' THEN a.text || '+'
                    ELSE a.text END AS rec_text,
               a.source NOT LIKE '%3' AS read_ok, a.source LIKE '%7' AS has_jbrd,
               a.source LIKE '%9' AS broken,
               CASE a.lang WHEN 'en' THEN 'sRGB@long2048+screen/d3e9s'
                    WHEN 'fr' THEN 'sRGB@long2048+screen/d3e7' WHEN 'de' THEN NULL
                    ELSE 'keep@pct50' END AS derived
        FROM {v_assets} a JOIN {labels} l ON a.doc_id = l.doc_id""",
    # Page facts of multi-image scans: one order is one file, one line a page.
    "v_pages": """
        SELECT l_orderkey AS source_id, '/scan/o' || CAST(l_orderkey AS STRING) || '.tif' AS path,
               'o' || CAST(l_orderkey AS STRING) AS stem, l_linenumber - 1 AS page,
               CASE WHEN max(l_returnflag) = 'R' AND l_linenumber > 1 THEN 1
                    WHEN max(l_returnflag) = 'N' AND max(l_suppkey) % 11 = 0 THEN 4
                    ELSE 0 END AS subfiletype,
               CASE CAST(max(l_suppkey) % 9 AS INT) WHEN 0 THEN 1 WHEN 1 THEN 4 WHEN 2 THEN 2
                    ELSE 3 END AS samples,
               CASE CAST(max(l_partkey) % 4 AS INT) WHEN 0 THEN '1' WHEN 1 THEN '2,0'
                    WHEN 2 THEN '0' ELSE '' END AS extras,
               CASE WHEN max(l_quantity) <= 6 THEN 160 WHEN max(l_quantity) <= 9 THEN 120
                    ELSE CAST(max(l_quantity) AS INT) * 100 END AS width,
               CASE WHEN max(l_quantity) <= 6 THEN 120 WHEN max(l_quantity) <= 9 THEN 160
                    ELSE CAST(max(l_quantity) AS INT) * 70 END AS height,
               CASE WHEN max(l_tax) > 0.06 THEN 6 ELSE 2 END AS photometric,
               CASE max(o_orderpriority) WHEN '1-URGENT' THEN 'SilverFast 8.8.0'
                    WHEN '2-HIGH' THEN 'Capture One 23' ELSE '' END AS software,
               CASE max(o_orderstatus) WHEN 'F' THEN 'scnr' WHEN 'O' THEN 'mntr' ELSE NULL END
                    AS icc_class,
               CASE WHEN max(o_custkey) % 2 = 0 THEN 8 ELSE 16 END AS bits,
               max(o_totalprice) > 300000 AS camera
        FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
        GROUP BY l_orderkey, l_linenumber""",
    # Members of split documents: line items, which repeat (order, line) pairs.
    "v_entries": """
        SELECT '/m/' || l_linestatus AS folder, CAST(l_orderkey AS STRING) AS group_id,
               l_linenumber - 1 AS page, l_returnflag = 'R' AND l_linenumber > 2 AS is_thumb,
               '/m/' || l_linestatus || '/k' || CAST(l_partkey AS STRING) || '-'
               || CAST(l_suppkey AS STRING) || '-'
               || CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING)
               || '/o' || CAST(l_orderkey AS STRING)
               || CASE WHEN l_linenumber > 1 THEN '_page' || CAST(l_linenumber - 1 AS STRING)
                  ELSE '' END
               || CASE WHEN l_returnflag = 'R' AND l_linenumber > 2 THEN '_thumbnail' ELSE '' END
               || '.jxl' AS path,
               CASE CAST(l_orderkey % 7 AS INT) WHEN 0 THEN NULL WHEN 1 THEN l_linenumber
                    ELSE 2 END AS declared,
               CASE WHEN l_tax > 0.07 THEN NULL ELSE 'c' || CAST(l_suppkey % 3 AS STRING) END
                    AS content_id,
               CASE WHEN l_returnflag = 'R' THEN 1 WHEN l_returnflag = 'A' THEN 4 ELSE 0 END
                    AS subfiletype,
               CASE WHEN l_suppkey % 2 = 0 THEN 8 WHEN l_suppkey % 3 = 0 THEN NULL ELSE 16 END
                    AS depth,
               l_partkey AS mtime, l_linenumber AS line, l_quantity AS quantity
        FROM {lineitem}""",
    # The same members split into two groups each, as a mixed-version archive.
    "v_fragments": """
        SELECT '/m/x' AS folder, CAST(l_orderkey AS STRING) || '-'
               || CAST(l_linenumber % 2 AS STRING) AS group_id,
               l_linenumber - 1 AS page, FALSE AS is_thumb,
               '/m/x/k' || CAST(l_partkey AS STRING) || '-' || CAST(l_suppkey AS STRING) || '-'
               || CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS STRING)
               || '/o' || CAST(l_orderkey AS STRING)
               || CASE WHEN l_linenumber > 1 THEN '_page' || CAST(l_linenumber - 1 AS STRING)
                  ELSE '' END || '.jxl' AS path,
               CASE WHEN l_orderkey % 5 = 0 THEN 3 ELSE 2 END AS declared,
               'c' || CAST(l_orderkey AS STRING) AS content_id, 0 AS subfiletype
        FROM {lineitem}""",
    # Chains of encodes, one order one asset; ties broken by every other column.
    "v_chain": """
        SELECT l_orderkey AS asset, l_linenumber AS pos,
               CAST(floor(l_partkey / 1000) AS BIGINT) AS bucket, l_partkey AS a, l_suppkey AS b,
               l_extendedprice AS c, l_discount AS d, CAST(l_quantity AS INT) % 9 + 1 AS e
        FROM {lineitem}""",
    # Record texts in their three homes.
    "v_records": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               CASE l_returnflag
                 WHEN 'R' THEN 'Project gen=3 phase ' || CAST(l_linenumber AS STRING) || ' | gen=2 | '
                   || 'cjxl d=' || CAST(CAST(l_discount AS DECIMAL(4,2)) AS STRING)
                   || ' e=' || CAST(CAST(l_quantity AS INT) % 9 + 1 AS STRING)
                   || ' | cjxl d=' || CAST(CAST(l_tax AS DECIMAL(4,2)) AS STRING) || ' e=7'
                 WHEN 'A' THEN 'Note: cjxl d=1 e=7 | My caption | gen='
                   || CAST(l_linenumber AS STRING)
                 ELSE 'gen=1 | cjxl d=' || CAST(CAST(l_tax AS DECIMAL(4,2)) AS STRING)
                   || ' e=7 | gen=' || CAST(l_linenumber AS STRING) || ' | cjxl d=1.2.3 e=9'
               END AS description,
               CASE WHEN l_linestatus = 'F'
                 THEN 'cjxl d=' || CAST(CAST(l_tax AS DECIMAL(4,2)) AS STRING) || ' e=7'
                 ELSE 'Capture One 23' END AS software,
               CASE WHEN l_shipdate >= TIMESTAMP '1998-01-01 00:00:00'
                 THEN 'encoder: from image/tiff to image/jxl | gen=1 | cjxl d='
                   || CAST(CAST(l_tax AS DECIMAL(4,2)) AS STRING) || ' e=7 | cjxl d=2.0 e='
                   || CAST(CAST(l_quantity AS INT) % 9 + 1 AS STRING)
                 WHEN l_discount = 0 THEN 'decoder: from image/jxl to image/tiff | no encode record'
                 ELSE 'editor' END AS history
        FROM {lineitem}""",
    # Marker lists, tokens separated by line breaks.
    "v_tokens": """
        SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
               '@NS@mpg:' || CAST(l_orderkey AS STRING)
               || chr(10) || '@NS@page:' || CASE WHEN l_tax = 0 THEN 'x'
                  ELSE CAST(l_linenumber - 1 AS STRING) END
               || chr(10) || '@NS@pages:' || CAST(l_linenumber + 1 AS STRING)
               || chr(10) || ' family '
               || CASE WHEN l_returnflag = 'R' THEN chr(10) || '@NS@thumb' ELSE '' END
               || CASE WHEN l_returnflag = 'A' THEN chr(10) || '@NS@origin:tiff16'
                  WHEN l_linestatus = 'F' THEN chr(10) || '@NS@origin:jpeg' ELSE '' END
               || CASE WHEN l_discount > 0.08 THEN chr(10) || '@NS@scan:raw'
                  WHEN l_discount > 0.06 THEN chr(10) || '@NS@scan:no' ELSE '' END
               || CASE WHEN l_suppkey % 4 = 0 THEN chr(10) || '@NS@subfiletype:4' ELSE '' END
               || CASE WHEN l_suppkey % 5 = 0
                  THEN chr(10) || '@NS@tifftag:35243:7:4A4B' || chr(10) || '@NS@tifftag:1:7:00'
                  ELSE '' END
               || chr(10) || '@NS@srcsum:s' || CAST(l_suppkey AS STRING)
               || CASE WHEN l_partkey % 3 = 0 THEN chr(10) || '@NS@derived:sRGB/d1e7' ELSE '' END
               || chr(10) || '@NS@extrasamples:' || CASE WHEN l_partkey % 2 = 0 THEN '1,2' ELSE 'a' END
                  AS relation,
               l_linestatus = 'F' AS has_record, l_discount > 0 AS read_ok,
               CASE WHEN l_partkey % 6 = 0 THEN 'VueScan 9' WHEN l_partkey % 6 = 1 THEN ''
                    ELSE 'Capture One' END AS software,
               l_quantity > 25 AS camera
        FROM {lineitem}""",
    # Run results out of the event stream.
    "v_results": """
        SELECT event_id, user_id, CAST(user_id % 10 AS INT) AS entry,
               '/in/u' || CAST(user_id AS STRING) AS folder,
               '/in/u' || CAST(user_id AS STRING) || '/f' || CAST(event_id AS STRING) AS src,
               CASE event_type WHEN 'click' THEN 'ok' WHEN 'view' THEN 'skipped'
                    WHEN 'purchase' THEN 'overwrite' ELSE event_type END AS status,
               CASE WHEN value > 100 THEN 'Cannot allocate memory'
                    WHEN value > 60 THEN 'REFUSED: output belongs to another source'
                    WHEN value > 30 THEN 'no readable pages (corrupt file)'
                    ELSE 'exit code 1' END AS detail, value, ts
        FROM {events}""",
    # One manifest row per customer: a folder to run with option cells.
    "v_manifest": """
        SELECT c_custkey AS row_no,
               '/lib/src' || CAST(c_custkey % 20 AS STRING)
               || CASE CAST(c_custkey % 4 AS INT) WHEN 0 THEN '' WHEN 1 THEN '/_EXPORT'
                  WHEN 2 THEN '/raw/r' || CAST(c_custkey % 25 AS STRING)
                  ELSE '/Lightroom_Export/r' || CAST(c_custkey % 25 AS STRING) || '/en' END AS Source,
               CASE WHEN c_nationkey = 3 THEN '/out/../x' WHEN c_nationkey = 5 THEN '/out'
                    ELSE '' END AS Destination,
               CASE WHEN c_nationkey = 7 THEN '7.5' WHEN c_nationkey = 8 THEN '7.0'
                    WHEN c_nationkey = 9 THEN ''
                    ELSE CAST(c_custkey % 9 AS STRING) END AS Mode,
               CASE WHEN c_nationkey = 11 THEN 'tiff2jxl' WHEN c_nationkey = 12 THEN ''
                    ELSE 'jxl2jxl' END AS Direction,
               CASE c_mktsegment WHEN 'FURNITURE' THEN 'sRGB' WHEN 'BUILDING' THEN 'mono.txt'
                    ELSE '' END AS OutputICC,
               CASE WHEN c_acctbal > 8000 THEN 'long:2048' WHEN c_acctbal > 7000 THEN '50%+up'
                    WHEN c_acctbal > 6500 THEN 'wide' ELSE '' END AS Resize,
               CASE WHEN c_acctbal < 0 THEN 'screen' WHEN c_acctbal < 300 THEN 'blur'
                    ELSE '' END AS Sharpen,
               CASE WHEN c_nationkey = 14 THEN 'DSC' WHEN c_nationkey = 15 THEN 'a/b' ELSE '' END
                    AS RenameFrom,
               CASE WHEN c_nationkey IN (14, 16) THEN 'IMG' ELSE '' END AS RenameTo,
               CASE WHEN c_nationkey = 17 THEN '_OUT' WHEN c_nationkey = 18 THEN 'a/b' ELSE '' END
                    AS ExportMarker,
               CASE WHEN c_nationkey IN (19, 20) THEN '16B' ELSE '' END AS ExportSubfolder,
               CASE c_nationkey WHEN 20 THEN '16b' WHEN 21 THEN 'My_EXPORT' WHEN 22 THEN 'small'
                    ELSE '' END AS ExportJxlFolder,
               CASE c_nationkey WHEN 23 THEN 'tmp;old' WHEN 24 THEN ' ; ' WHEN 0 THEN '-'
                    WHEN 1 THEN 'NONE' ELSE '' END AS ExcludeFolders
        FROM {customer}""",
    # URL paths as one more kind of path.
    "v_urls": """
        SELECT page_id, regexp_replace('/' || substr(url, position('//' IN url) + 2), '/$', '') AS path
        FROM {pages}""",
}

_NAME = re.compile(r"\{(\w+)\}")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One given table; the scan's split settings decide how it is cut, at every size."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table or view as a DataFrame."""
    if name in TABLES:
        return read_table(spark, sf_dir, name)
    text = VIEWS[name].replace("@NS@", TOKEN_NAMESPACE)
    parts = {n: view(spark, sf_dir, n) for n in set(_NAME.findall(text))}
    return spark.sql(text, **parts)


def oracle(sql: str) -> str:
    """An oracle statement with the views it names as common table expressions."""
    ordered: list[str] = []

    def need(text: str) -> None:
        for name in sorted(set(re.findall(r"\bv_\w+\b", text))):
            if name in VIEWS and name not in ordered:
                need(VIEWS[name])
                ordered.append(name)

    need(sql)
    ctes = [f"{n} AS ({VIEWS[n].format_map(_Same())})" for n in ordered]
    body = sql.strip()
    if body.upper().startswith("WITH "):
        head = "WITH " + ",\n".join(ctes + [body[5:]]) if ctes else body
    else:
        head = ("WITH " + ",\n".join(ctes) + "\n" + body) if ctes else body
    return head.replace("@NS@", TOKEN_NAMESPACE)


class _Same(dict):
    def __missing__(self, key: str) -> str:
        return key
