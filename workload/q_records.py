"""Records, tokens, scalar functions, lineage."""

from __future__ import annotations

from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark.functions import recipes as RC
from shelfmark.functions import records as R
from shelfmark.functions import scalars as S
from shelfmark.functions import tokens as T
from shelfmark.operators import lineage, policy
from workload.registry import query

KEY = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice"
KEYS = KEY.split(", ")
BLOCK = fv.BLOCK_PATTERN
ENTRY = fv.ENTRY_PATTERN


def chain_sql(text: str) -> str:
    """Entries of the machine blocks, as a list of 'd/e' texts."""
    blocks = f"regexp_extract_all({text}, '{BLOCK}')"
    joined = f"COALESCE(list_aggregate({blocks}, 'string_agg', ' | '), '')"
    return (f"[regexp_extract(x, '{ENTRY}', 1) || '/' || regexp_extract(x, '{ENTRY}', 2) "
            f"FOR x IN regexp_extract_all({joined}, '{ENTRY}', 0)]")


def gens_sql(text: str) -> str:
    """Whole-segment gen tokens, found by splitting on the bar."""
    return (f"COALESCE(list_max([CAST(substr(trim(x), 5) AS INT) FOR x IN string_split({text}, '|') "
            f"IF regexp_full_match(trim(x), 'gen=\\d+')]), 0)")


def counted_sql(chain: str) -> str:
    return f"len([x FOR x IN {chain} IF COALESCE(TRY_CAST(string_split(x, '/')[1] AS DOUBLE), 0) > 0])"


@query("parse_chain", "F1", f"""
    SELECT {KEY}, COALESCE(list_aggregate({chain_sql('description')}, 'string_agg', ','), '') AS chain,
           len({chain_sql('description')}) AS entries FROM v_records""")
def parse_chain(s):
    entries = R.parse_entries("description")
    return s.v_records.select(
        *KEYS, F.array_join(F.transform(entries, lambda x: F.concat_ws("/", x["d"], x["e"])), ",")
        .alias("chain"), F.size(entries).cast("bigint").alias("entries"))


@query("strip_record", "F2", f"""
    SELECT {KEY}, CASE l_returnflag WHEN 'R' THEN 'Project gen=3 phase ' || CAST(l_linenumber AS VARCHAR)
        WHEN 'A' THEN 'Note: cjxl d=1 e=7 | My caption' ELSE '' END AS caption,
        CASE l_returnflag WHEN 'A' THEN 1 ELSE 0 END AS orphans
    FROM lineitem""")
def strip_record(s):
    return s.v_records.select(
        *KEYS, R.strip_record("description").alias("caption"),
        R.orphan_count("description").alias("orphans"))


@query("append_record", "F3", f"""
    WITH c AS (SELECT *, {chain_sql('description')} AS chain, {gens_sql('description')} AS stored,
                 CASE WHEN starts_with(description, 'Project') THEN split_part(description, ' | ', 1) || ' | '
                      WHEN starts_with(description, 'Note') THEN 'Note: cjxl d=1 e=7 | My caption | '
                      ELSE '' END AS caption FROM v_records)
    SELECT {KEY}, caption || 'gen=' || CAST(greatest(stored, {counted_sql('chain')} + 1) AS VARCHAR) || ' | '
        || list_aggregate(list_concat(
             ['cjxl d=' || replace(x, '/', ' e=') FOR x IN chain], ['cjxl d=3.0 e=9']), 'string_agg', ' | ')
        AS record
    FROM c""")
def append_record(s):
    return s.v_records.select(
        *KEYS, R.append_record("description", F.lit("3.0"), F.lit(9)).alias("record"))


@query("parse_markers", "F4", f"""
    SELECT {KEY}, CAST(l_orderkey AS VARCHAR) AS group_id,
        CASE WHEN l_tax = 0 THEN -1 ELSE l_linenumber - 1 END AS page, l_linenumber + 1 AS pages,
        CASE WHEN l_suppkey % 4 = 0 THEN 4 ELSE 0 END AS subfiletype, l_returnflag = 'R' AS is_thumb,
        CASE WHEN l_returnflag = 'A' THEN 'tiff16' WHEN l_linestatus = 'F' THEN 'jpeg' END AS origin,
        CASE WHEN l_discount > 0.08 THEN 'raw' WHEN l_discount > 0.06 THEN 'no' END AS scan,
        's' || CAST(l_suppkey AS VARCHAR) AS srcsum,
        CASE WHEN l_partkey % 3 = 0 THEN 'sRGB/d1e7' END AS derived,
        CASE WHEN l_partkey % 2 = 0 THEN '1,2' END AS extrasamples,
        CASE WHEN l_suppkey % 5 = 0 THEN '35243:7:4A4B' ELSE '' END AS tags
    FROM lineitem""")
def parse_markers(s):
    m = T.parse_markers(F.split("relation", "\n"))
    return s.v_tokens.select(*KEYS, m.alias("m")).select(
        *KEYS, "m.group_id", F.coalesce("m.page", F.lit(-1)).alias("page"), "m.pages",
        "m.subfiletype", "m.is_thumb", "m.origin", "m.scan", "m.srcsum", "m.derived",
        F.when(F.col("m.extrasamples").isNotNull(),
               F.array_join(F.col("m.extrasamples").cast("array<string>"), ",")).alias("extrasamples"),
        F.array_join(F.transform(F.col("m.tags"), lambda t: F.concat_ws(
            ":", t["code"].cast("string"), t["type"].cast("string"), F.hex(t["bytes"]))), ";")
        .alias("tags"))


@query("parse_tag", "F5", """
    SELECT p_partkey, CASE WHEN p_size % 4 = 0 AND p_partkey >= 2 THEN 32768 + p_partkey ELSE -1 END AS code,
        CASE WHEN p_size % 4 = 0 AND p_partkey >= 2 THEN upper(hex(encode(p_name))) END AS bytes
    FROM part""")
def parse_tag(s):
    code = F.when(F.col("p_partkey") < 2, 7).otherwise(F.col("p_partkey") + 32768)
    kind = (F.when(F.col("p_size") % 4 == 0, "7").when(F.col("p_size") % 4 == 1, "4")
            .when(F.col("p_size") % 4 == 2, "x").otherwise("7"))
    digits = F.when(F.col("p_size") % 4 == 3, F.concat(F.hex("p_name"), F.lit("Z"))).otherwise(
        F.lower(F.hex("p_name")))
    tag = T.parse_tag(F.concat_ws(":", code.cast("string"), kind, digits))
    return s.part.select(
        "p_partkey", F.coalesce(tag["code"], F.lit(-1)).cast("bigint").alias("code"),
        F.hex(tag["bytes"]).alias("bytes"))


@query("human_size", "F6", """
    SELECT o_orderkey, CASE WHEN n >= 1099511627776 THEN printf('%.1f TB', n / 1099511627776)
        WHEN n >= 1073741824 THEN printf('%.1f GB', n / 1073741824)
        WHEN n >= 1048576 THEN printf('%.1f MB', n / 1048576)
        ELSE CAST(CAST(round_even(n / 1024, 0) AS BIGINT) AS VARCHAR) || ' KB' END AS label
    FROM (SELECT o_orderkey, CAST(CAST(floor(o_totalprice) AS BIGINT) AS DOUBLE)
              * CASE o_orderstatus WHEN 'F' THEN 1 WHEN 'O' THEN 4096 ELSE 8388608 END AS n FROM orders)""")
def human_size(s):
    size = F.floor("o_totalprice") * (
        F.when(F.col("o_orderstatus") == "F", 1).when(F.col("o_orderstatus") == "O", 4096)
        .otherwise(8388608))
    return s.orders.select("o_orderkey", S.fmt_size(size).alias("label"))


@query("mime_types", "F7", """
    SELECT p_partkey, CASE p_size % 5 WHEN 0 THEN 'image/tiff' WHEN 1 THEN 'image/jpeg'
        WHEN 2 THEN 'image/png' WHEN 3 THEN 'image/jxl' END AS mime FROM part""")
def mime_types(s):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".TIF", ".jpeg.tmp", ".png", ".Jxl.TMP", ".txt")]),
                       (F.col("p_size") % 5 + 1).cast("int"))
    return s.part.select("p_partkey", S.mime_of(F.concat("p_name", ext)).alias("mime"))


@query("sample_depths", "F8", """
    SELECT vec_id, [x * 257 FOR x IN s]::VARCHAR AS wide,
        [CAST(round_even(x * 129 / 257, 0) AS INT) FOR x IN s]::VARCHAR AS narrow
    FROM (SELECT vec_id, [CAST(round_even((CAST(x AS DOUBLE) + 1) * 127, 0) AS INT) FOR x IN embedding] AS s
          FROM embeddings)""")
def sample_depths(s):
    samples = F.transform("embedding", lambda x: F.bround((x.cast("double") + 1) * 127, 0).cast("int"))
    shown = [
        F.concat(F.lit("["), F.array_join(c.cast("array<string>"), ", "), F.lit("]"))
        for c in (S.widen("s"), S.narrow(F.transform("s", lambda x: x * 129)))]
    return s.embeddings.select("vec_id", samples.alias("s")).select(
        "vec_id", shown[0].alias("wide"), shown[1].alias("narrow"))


# --- fixed values: the published sRGB-form curve -------------------------------
SRGB = (4, (2.4, 1 / 1.055, 0.055 / 1.055, 1 / 12.92, 0.04045))
GAMMA = (1, (1.8,))


@query("tone_curves", "F9", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        round(CASE WHEN x >= 0.04045 THEN pow((x + 0.055) / 1.055, 2.4) ELSE x / 12.92 END, 6) AS srgb,
        round(pow(x, 1.8), 6) AS gamma,
        round(CASE WHEN x >= 0.0031308 THEN 1.055 * pow(x, 1 / 2.4) - 0.055 ELSE x * 12.92 END, 4) AS srgb_back,
        round(pow(x, 1 / 1.8), 6) AS gamma_back
    FROM (SELECT *, (l_quantity - 1) / 49 AS x FROM lineitem)""")
def tone_curves(s):
    x = (F.col("l_quantity") - 1) / 49
    return s.lineitem.select(
        *KEYS, F.round(S.curve_forward(x, *SRGB), 6).alias("srgb"),
        F.round(S.curve_forward(x, *GAMMA), 6).alias("gamma"),
        F.round(S.curve_inverse(x, *SRGB), 4).alias("srgb_back"),
        F.round(S.curve_inverse(x, *GAMMA), 6).alias("gamma_back"))


@query("parse_history", "F12", f"""
    SELECT {KEY}, CASE WHEN contains(history, ':') THEN split_part(history, ':', 1)
             ELSE trim(split_part(history, '|', 1)) END AS script,
        nullif(regexp_extract(history, 'from (\\S+) to', 1), '') AS mime_from,
        nullif(regexp_extract(history, ' to (\\S+)', 1), '') AS mime_to,
        strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') AS written
    FROM v_records JOIN lineitem USING ({KEY})""")
def parse_history(s):
    stamp = F.date_format("l_shipdate", "yyyy:MM:dd HH:mm:ss")
    joined = s.v_records.join(s.lineitem.select(*KEYS, stamp.alias("stamp")), KEYS)
    h = R.parse_history("history")
    return joined.select(
        *KEYS, h["script"].alias("script"), h["mime_from"].alias("mime_from"), h["mime_to"].alias("mime_to"),
        F.date_format(R.parse_when("stamp"), "yyyy-MM-dd HH:mm:ss").alias("written"))


@query("content_digests", "F13", """
    SELECT doc_id, left(sha256(unhex(sha256(text))), 16) AS content_id, md5(text) AS md5,
           sha256(text) AS digest FROM documents""")
def content_digests(s):
    return s.documents.select(
        "doc_id", S.content_id("text").alias("content_id"), S.md5_of("text").alias("md5"),
        S.content_digest("text").alias("digest"))


@query("psnr", "F14", """
    SELECT o_orderkey, CASE WHEN m = 0 THEN 'inf' ELSE printf('%.4f', 10 * log10(65535.0 * 65535.0 / m)) END AS psnr
    FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'P' THEN 0 ELSE o_totalprice END AS m FROM orders)""")
def psnr(s):
    mse = F.when(F.col("o_orderstatus") == "P", 0.0).otherwise(F.col("o_totalprice"))
    value = S.psnr(mse)
    return s.orders.select("o_orderkey", F.when(
        value == float("inf"), "inf").otherwise(F.format_string("%.4f", value)).alias("psnr"))


@query("json_fields", "F15", """
    SELECT event_id, json_extract_string(props, '$.k') AS k, json_extract_string(props, '$.none') AS none
    FROM events""")
def json_fields(s):
    return s.events.select("event_id", S.json_field("props", "$.k").alias("k"),
                           S.json_field("props", "$.none").alias("none"))


@query("fill_fields", "F16", """
    SELECT doc_id, CASE WHEN quality IS NULL THEN lang ELSE 'kept' END AS "Headline",
        CASE WHEN lang = 'en' THEN source ELSE 'here' END AS "City", nullif(lang, 'en') AS "Title",
        CASE WHEN quality IS NULL THEN source || ',' || lang ELSE 'own' END AS words
    FROM documents LEFT JOIN labels USING (doc_id)""")
def fill_fields(s):
    known = F.col("quality").isNotNull()
    rows = s.documents.join(s.labels.select("doc_id", "quality"), "doc_id", "left").select(
        "doc_id",
        F.struct(F.col("lang").alias("Headline"), F.col("source").alias("City"),
                 F.when(F.col("lang") == "en", "").otherwise(F.col("lang")).alias("ObjectName"))
        .alias("iptc"),
        F.struct(F.when(known, "kept").alias("Headline"),
                 F.when(F.col("lang") == "en", "").otherwise("here").alias("City"),
                 F.lit(None).cast("string").alias("Title")).alias("xmp"),
        F.when(known, F.array(F.lit("own"))).otherwise(F.array().cast("array<string>")).alias("have"),
        F.array("source", "lang").alias("offer"))
    pairs = [p for p in fv.FIELD_FILL if p[0] in ("Headline", "City", "ObjectName")]
    return rows.select("doc_id", *S.fill_fields(pairs),
                       F.array_join(S.fill_array("have", "offer"), ",").alias("words"))


@query("token_sets", "X1", f"""
    SELECT {KEY}, 'family' AS own,
        list_aggregate(list_concat([trim(x) FOR x IN string_split(relation, chr(10))
            IF NOT regexp_matches(trim(x), '^@NS@(src|srcsum|derived):')],
            ['@NS@derived:sRGB@long2048/d3e9']), 'string_agg', ',') AS derived
    FROM v_tokens""")
def token_sets(s):
    tokens = F.split("relation", "\n")
    return s.v_tokens.select(
        *KEYS, F.array_join(T.user_tokens(tokens), ",").alias("own"),
        F.array_join(T.derived_tokens(tokens, "sRGB@long2048/d3e9"), ",").alias("derived"))


@query("output_origin", "P35", f"""
    SELECT {KEY}, CASE WHEN l_discount = 0 THEN NULL WHEN l_returnflag = 'A' THEN 'tiff16'
        WHEN l_linestatus = 'F' THEN 'jpeg' END AS inherited,
        CASE WHEN l_linestatus <> 'F' THEN 'png16' END AS clean
    FROM lineitem""")
def output_origin(s):
    tokens = F.split("relation", "\n")
    return s.v_tokens.select(
        *KEYS, T.output_origin(tokens, "has_record", "png16", "read_ok").alias("inherited"),
        T.output_origin(T.user_tokens(tokens), "has_record", "png16").alias("clean"))


def _profile_bytes():
    """128 header bytes with the profile mark, then the document's own text."""
    return F.concat(
        F.unhex(F.lit("00" * 36)), F.lit("acsp").cast("binary"), F.unhex(F.lit("00" * 88)),
        F.col("text").cast("binary"))


@query("carried_profile", "P36", """
    SELECT doc_id, CASE WHEN lang = 'fr' THEN NULL WHEN lang = 'de' AND source LIKE '%1' THEN NULL
        ELSE md5(encode(repeat(chr(0), 36) || 'acsp' || repeat(chr(0), 88) || text)) END AS profile
    FROM documents""")
def carried_profile(s):
    coded = F.regexp_replace(F.base64(_profile_bytes()), r"\s", "")
    token = (F.when(F.col("lang") == "en", F.concat(F.lit(fv.ICC_PROFILE), coded))
             .otherwise(F.concat(F.lit(fv.ICC_PROFILE), F.lit("@broken"))))
    creator = (
        F.when(F.col("lang") == "fr", F.concat(F.lit("Tool | ICC:"), F.substring(coded, 1, 40)))
        .when((F.col("lang") == "de") & F.col("source").like("%1"), "Tool")
        .otherwise(F.concat(F.lit("Tool | ICC: "), coded)))
    return s.documents.select(
        "doc_id", F.md5(T.carried_profile(F.array(F.lit("word"), token), creator)).alias("profile"))


@query("master_kind", "P14", f"""
    SELECT {KEY}, CASE WHEN l_discount > 0.08 THEN 'raw' WHEN l_discount > 0.06 THEN NULL
        WHEN l_suppkey % 4 = 0 OR l_partkey % 6 = 0 THEN 'unknown'
        WHEN l_returnflag = 'A' AND l_partkey % 6 = 1 AND l_quantity <= 25 THEN 'unknown' END AS kind
    FROM lineitem""")
def master_kind(s):
    return s.v_tokens.select(
        *KEYS, policy.master_kind(F.split("relation", "\n"), "software", "camera").alias("kind"))


@query("reconcile_generations", "A8", f"""
    SELECT {KEY}, {gens_sql('description')} AS stored, {counted_sql(chain_sql('description'))} AS counted,
        greatest({gens_sql('description')}, {counted_sql(chain_sql('description'))}) AS gen
    FROM v_records""")
def reconcile_generations(s):
    out = lineage.reconcile_gen(s.v_records, "description")
    return out.select(*KEYS, "stored", F.col("counted").cast("bigint"), F.col("gen").cast("bigint"))


@query("reconcile_generations_rows", "A8", """
    SELECT asset, count(*) AS entries, count(*) FILTER (d > 0) AS counted, CAST(max(pos) AS BIGINT) AS stored,
        greatest(count(*) FILTER (d > 0), max(pos)) AS gen
    FROM v_chain GROUP BY asset""")
def reconcile_generations_rows(s):
    out = lineage.reconcile_gen_rows(s.v_chain, ["asset"], stored="pos")
    return out.select("asset", "entries", "counted", F.col("stored").cast("bigint"), F.col("gen").cast("bigint"))


def _fold(a: str, b: str) -> str:
    return (f"CASE WHEN {b}[1:len({a})] = {a} THEN {b} WHEN {a}[1:len({b})] = {b} THEN {a} "
            f"ELSE list_concat({a}, {b}) END")


@query("merge_lineage", "A9", f"""
    WITH c AS (SELECT *, {chain_sql('description')} AS a, {chain_sql('software')} AS b,
                      {chain_sql('history')} AS h FROM v_records),
    ab AS (SELECT *, {_fold('a', 'b')} AS ab FROM c),
    m AS (SELECT *, {_fold('ab', 'h')} AS m FROM ab)
    SELECT {KEY}, COALESCE(list_aggregate(['cjxl d=' || replace(x, '/', ' e=') FOR x IN m], 'string_agg', ' | '), '')
        AS merged, len(m) AS entries, greatest({gens_sql('description')}, {gens_sql('software')},
        {gens_sql('history')}, {counted_sql('m')}) AS gen FROM m""")
def merge_lineage(s):
    return lineage.merge_lineage(s.v_records).select(
        *KEYS, "merged", F.col("entries").cast("bigint"), F.col("gen").cast("bigint"))


@query("latest_record", "W3", f"""
    WITH h AS (SELECT l_orderkey, l_linenumber * 1000000000000000 + l_partkey * 100000000 + CAST(floor(l_extendedprice * 100) AS BIGINT) AS pos, history,
        regexp_extract_all(history, '{BLOCK}') AS blocks FROM v_records),
    r AS (SELECT *, contains(history, 'no encode record') AS stops,
        row_number() OVER (PARTITION BY l_orderkey
            ORDER BY len(blocks) > 0 OR contains(history, 'no encode record') DESC, pos DESC) AS rn FROM h)
    SELECT l_orderkey, CASE WHEN len(blocks) > 0 OR stops THEN pos ELSE -1 END AS record_pos,
        CASE WHEN len(blocks) > 0 AND NOT stops
        THEN list_aggregate([trim(trim(x), '| ') FOR x IN blocks], 'string_agg', ' | ') ELSE '' END AS record
    FROM r WHERE rn = 1""")
def latest_record(s):
    history = s.v_records.select(
        "l_orderkey", (F.col("l_linenumber") * F.lit(10 ** 15) + F.col("l_partkey") * F.lit(10 ** 8)
                       + F.floor(F.col("l_extendedprice") * 100)).alias("pos"), F.col("history").alias("text"))
    return lineage.latest_record(history, ["l_orderkey"]).select(
        "l_orderkey", F.coalesce("record_pos", F.lit(-1)).alias("record_pos"), "record")


CHAIN_ORDER = "pos, bucket, a, b, c"


@query("chain_generations", "W4", f"""
    SELECT asset, {CHAIN_ORDER}, d, CAST(sum(CASE WHEN d > 0 THEN 1 ELSE 0 END) OVER (
        PARTITION BY asset ORDER BY {CHAIN_ORDER} ROWS UNBOUNDED PRECEDING) AS BIGINT) AS generation
    FROM v_chain""")
def chain_generations(s):
    return lineage.chain_generations(
        s.v_chain, ["asset"], ["pos", "bucket"], ["a", "b", "c"]).select(
            "asset", "pos", "bucket", "a", "b", "c", "d", "generation")


@query("chain_steps", "W5", f"""
    WITH p AS (SELECT *, lag(d) OVER w AS pd, lag(e) OVER w AS pe FROM v_chain
               WINDOW w AS (PARTITION BY asset ORDER BY {CHAIN_ORDER}))
    SELECT asset, {CHAIN_ORDER}, COALESCE(pd, -1) AS prev_d, COALESCE(pe, -1) AS prev_e,
        CASE WHEN pd IS NULL THEN NULL
             WHEN pd = 0 AND d = 0 THEN CASE WHEN e > pe THEN 'ok' ELSE 'downgrade' END
             WHEN CASE WHEN d = 0 THEN 0 ELSE greatest(d, 0.05) END
                > CASE WHEN pd = 0 THEN 0 ELSE greatest(pd, 0.05) END THEN 'ok' ELSE 'downgrade' END AS step
    FROM p""")
def chain_steps(s):
    return lineage.chain_steps(s.v_chain, ["asset"], ["pos", "bucket"], ["a", "b", "c"]).select(
        "asset", "pos", "bucket", "a", "b", "c", F.coalesce("prev_d", F.lit(-1.0)).alias("prev_d"),
        F.coalesce("prev_e", F.lit(-1)).alias("prev_e"), "step")


LABEL_SQL = """CASE CAST(l_partkey % 3 AS INT) WHEN 0 THEN 'sRGB' WHEN 1 THEN 'keep@pct50' ELSE 'AdobeRGB@long320+print' END
    || CASE WHEN l_returnflag = 'R' THEN '' ELSE '/d' || CAST(CAST(l_quantity % 3 AS INT) AS STRING) || 'e'
       || CAST(CAST(l_suppkey % 9 AS INT) + 1 AS STRING) || CASE WHEN l_tax > 0.04 THEN 's' ELSE '' END END"""


@query("recipe_labels", "P22", """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        CASE l_returnflag WHEN 'R' THEN 'sRGB' WHEN 'A' THEN 'AdobeRGB' ELSE 'keep' END
        || CASE l_linestatus WHEN 'F' THEN '@long' || CAST(l_linenumber * 320 AS VARCHAR) ELSE '@pct12.5' END
        || CASE WHEN l_discount > 0.05 THEN '+up' ELSE '' END
        || CASE WHEN l_tax > 0.04 THEN '+screen' ELSE '' END || '/d'
        || CASE WHEN l_discount = 0 THEN '0' WHEN l_discount < 0.05 THEN '0.05'
           WHEN l_discount = 0.1 THEN '0.1' ELSE CAST(CAST(l_discount AS DECIMAL(4,2)) AS VARCHAR) END
        || 'e' || CAST(CAST(l_quantity AS INT) % 10 + 1 AS VARCHAR)
        || CASE WHEN CAST(l_quantity AS INT) % 10 + 1 >= 10 THEN '' ELSE 's' END AS label,
        CASE WHEN l_linenumber > 3 THEN '/q' || CAST(l_linenumber * 10 AS VARCHAR) ELSE '' END AS quality
    FROM lineitem""")
def recipe_labels(s):
    long_side = F.col("l_linestatus") == "F"
    recipe = RC.recipe_label(
        F.when(F.col("l_returnflag") == "R", "sRGB").when(F.col("l_returnflag") == "A", "AdobeRGB"),
        F.when(long_side, "long").otherwise("percent"),
        F.when(long_side, F.col("l_linenumber") * 320).otherwise(12.5),
        F.col("l_discount") > 0.05, F.when(F.col("l_tax") > 0.04, "screen").otherwise("none"))
    suffix = RC.encode_suffix("l_discount", F.col("l_quantity").cast("int") % 10 + 1)
    quality = RC.quality_suffix(F.when(F.col("l_linenumber") > 3, F.col("l_linenumber") * 10))
    return s.lineitem.select(*KEYS, F.concat(recipe, suffix).alias("label"), quality.alias("quality"))


@query("parse_recipes", "P23", f"""
    WITH l AS (SELECT {KEY}, {LABEL_SQL} AS label, l_returnflag, l_tax, CAST(l_quantity % 3 AS INT) AS d,
        CAST(l_suppkey % 9 AS INT) + 1 AS e FROM lineitem)
    SELECT {KEY}, split_part(label, '/', 1) AS recipe,
        CASE WHEN l_returnflag = 'R' THEN -1.0 ELSE CAST(d AS DOUBLE) END AS d,
        CASE WHEN l_returnflag = 'R' THEN -1 ELSE e END AS e,
        CASE WHEN l_returnflag = 'R' THEN -1 WHEN l_tax > 0.04 AND d > 0 THEN 2 * least(e, 7)
             WHEN l_tax > 0.04 THEN 2 * e ELSE 2 * e + 1 END AS encode_rank
    FROM l""")
def parse_recipes(s):
    r = RC.parse_recipe(F.expr(LABEL_SQL))
    return s.lineitem.select(*KEYS, r.alias("r")).select(
        *KEYS, "r.recipe", F.coalesce("r.d", F.lit(-1.0)).alias("d"), F.coalesce("r.e", F.lit(-1)).alias("e"),
        F.coalesce("r.rank", F.lit(-1)).alias("encode_rank"))


@query("rederive_reasons", "P24", f"""
    WITH l AS (SELECT {KEY}, {LABEL_SQL} AS label, l_returnflag = 'R' AS bare,
        CAST(l_partkey % 3 AS INT) AS r, CAST(l_quantity % 3 AS INT) AS d, l_tax > 0.04 AS st,
        CAST(l_suppkey % 9 AS INT) + 1 AS e FROM lineitem),
    k AS (SELECT *, CASE WHEN st AND d > 0 THEN least(e, 7) ELSE e END AS eff FROM l)
    SELECT {KEY}, CASE WHEN r <> 0 THEN 'derivative recipe changed' WHEN bare THEN NULL
        WHEN d <> 1 THEN 'encode settings changed'
        WHEN eff < 7 OR (eff = 7 AND st) THEN 'encode settings changed' END AS reason,
        CASE WHEN r <> 0 THEN 'derivative recipe changed' WHEN bare THEN NULL
        WHEN d <> 1 THEN 'encode settings changed'
        WHEN NOT (eff = 7 AND NOT st) THEN 'encode settings changed' END AS reason_lower,
        CASE WHEN r <> 0 THEN 'derivative recipe changed' END AS reason_unchecked
    FROM k""")
def rederive_reasons(s):
    label, wanted = F.expr(LABEL_SQL), F.lit("sRGB/d1e7")
    return s.lineitem.select(
        *KEYS, RC.rederive_reason(label, wanted).alias("reason"),
        RC.rederive_reason(label, wanted, True, True).alias("reason_lower"),
        RC.rederive_reason(label, wanted, False).alias("reason_unchecked"))


@query("best_derivative", "W6", f"""
    WITH l AS (SELECT l_orderkey AS master, {LABEL_SQL} AS label, CAST(l_quantity % 3 AS INT) AS d0,
        l_returnflag = 'R' AS bare, l_tax > 0.04 AS st, CAST(l_suppkey % 9 AS INT) + 1 AS e,
        CAST(l_partkey AS VARCHAR) || '/' || CAST(l_suppkey AS VARCHAR) || '/' || CAST(l_linenumber AS VARCHAR)
        || '/' || CAST(CAST(floor(l_extendedprice * 100) AS BIGINT) AS VARCHAR) AS path FROM lineitem),
    k AS (SELECT *, split_part(label, '/', 1) AS recipe, CASE WHEN bare THEN -1.0 ELSE d0 END AS d,
        CASE WHEN bare THEN -1 WHEN st AND d0 > 0 THEN 2 * least(e, 7) WHEN st THEN 2 * e ELSE 2 * e + 1 END
        AS encode_rank FROM l),
    r AS (SELECT *, row_number() OVER (PARTITION BY master, recipe, d ORDER BY encode_rank DESC, path) AS rn FROM k)
    SELECT master, recipe, CAST(d AS DOUBLE) AS d, encode_rank, path, label FROM r WHERE rn = 1""")
def best_derivative(s):
    path = F.concat_ws("/", "l_partkey", "l_suppkey", "l_linenumber",
                       F.floor(F.col("l_extendedprice") * 100))
    labels = s.lineitem.select(F.col("l_orderkey").alias("master"), F.expr(LABEL_SQL).alias("label"),
                               path.alias("path"))
    return lineage.best_derivative(labels).select(
        "master", "recipe", F.coalesce("d", F.lit(-1.0)).alias("d"),
        F.coalesce("encode_rank", F.lit(-1)).alias("encode_rank"), "path", "label")


@query("resize_geometry", "P25", """
    WITH b AS (SELECT *, CAST(l_quantity AS INT) * 100 AS w, CAST(l_suppkey AS INT) + 500 AS h FROM lineitem),
    s AS (SELECT *, CASE l_returnflag WHEN 'R' THEN 2048.0 / greatest(w, h) WHEN 'A' THEN 1080.0 / least(w, h)
        ELSE CAST(l_discount * 1000 AS DOUBLE) / 100.0 END AS scale FROM b),
    g AS (SELECT *, greatest(1, CAST(round_even(w * scale, 0) AS INT)) AS nw,
        greatest(1, CAST(round_even(h * scale, 0) AS INT)) AS nh FROM s)
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice,
        CASE WHEN scale > 0 AND (scale <= 1 OR l_tax > 0.04) AND (nw <> w OR nh <> h)
        THEN CAST(nw AS VARCHAR) || 'x' || CAST(nh AS VARCHAR) END AS size
    FROM g""")
def resize_geometry(s):
    flag = F.col("l_returnflag")
    mode = F.when(flag == "R", "long").when(flag == "A", "short").otherwise("percent")
    value = F.when(flag == "R", 2048.0).when(flag == "A", 1080.0).otherwise(F.col("l_discount") * 1000)
    w, h = F.col("l_quantity").cast("int") * 100, F.col("l_suppkey").cast("int") + 500
    out = RC.resize_geometry(w, h, mode, value, F.col("l_tax") > 0.04)
    return s.lineitem.select(*KEYS, F.concat_ws(
        "x", out["width"].cast("string"), out["height"].cast("string")).alias("size")).withColumn(
            "size", F.nullif("size", F.lit("")))
