"""Per-asset decisions: kinds, quality targets, page plans, actions, routes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfmark import fixed_values as fv
from shelfmark import skew
from shelfmark.config import DeriveConfig, PolicyConfig
from shelfmark.functions import records as R
from shelfmark.functions import tokens as T
from shelfmark.functions.numbers import recorded_number, whole_number


def _col(value) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _names_any(text: Column, words) -> Column:
    """Does ``text`` contain one of ``words``, letter case ignored?"""
    low = F.lower(F.coalesce(text, F.lit("")))
    hits = [low.contains(w.lower()) for w in words if w.strip()]
    return reduce(lambda a, b: a | b, hits, F.lit(False))


# -- pages ---------------------------------------------------------------------


def is_thumbnail_page(page, width, height) -> Column:
    """A later page of at most 160 px on its long side."""
    side = F.greatest(F.coalesce(_col(width), F.lit(0)), F.coalesce(_col(height), F.lit(0)))
    return F.coalesce(
        (side > 0) & (side <= fv.CAMERA_THUMB_MAX_SIDE) & (_col(page) > 0), F.lit(False))


def _page_has_ir() -> Column:
    mask = F.coalesce(F.col("subfiletype"), F.lit(0)).bitwiseAND(F.lit(4)) != 0
    alpha = F.coalesce(
        F.arrays_overlap(F.col("extrasamples"), F.array(F.lit(1), F.lit(2))), F.lit(False))
    return mask | (F.coalesce(F.col("samples"), F.lit(0)).isin(2, 4) & ~alpha)


def source_facts(pages: DataFrame, keys=("path",)) -> DataFrame:
    """The aggregates P12, P13 and P16 decide on, one row per source."""
    first = F.col("page") == 0
    dcf = reduce(lambda a, b: a | b, [
        (F.col("width") == w) & (F.col("height") == h) for w, h in fv.DCF_THUMBNAIL_SIZES])
    return pages.groupBy(*keys).agg(
        F.max(F.when(first, F.col("software"))).alias("software"),
        F.max(F.when(first, F.col("icc_class"))).alias("icc_class"),
        F.coalesce(F.max(F.when(first, F.col("bits"))), F.lit(0)).alias("bits"),
        F.coalesce(F.max(F.when(first, F.col("camera"))), F.lit(False)).alias("camera"),
        F.max(_page_has_ir()).alias("has_ir"),
        F.coalesce(F.max(~first & dcf), F.lit(False)).alias("dcf_thumbnail"),
    )


def _reason(cfg: PolicyConfig) -> Column:
    software = F.col("software")
    named = F.trim(F.coalesce(software, F.lit(""))) != ""
    return (
        F.when(_names_any(software, cfg.scanner_software), F.lit("software"))
        .when(F.col("has_ir"), F.lit("ir"))
        .when(named | F.col("camera"), F.lit(None).cast("string"))
        .when(F.col("dcf_thumbnail"), F.lit("camera"))
        .otherwise(F.lit("guessed")))


def _kind(reason: Column) -> Column:
    icc = F.coalesce(F.col("icc_class"), F.lit(""))
    raw = F.col("has_ir") | (icc == "scnr") | ((icc == "") & (F.col("bits") >= 16))
    return F.when(
        reason.isin("software", "ir", "guessed"),
        F.when(raw, F.lit("raw")).otherwise(F.lit("final")))


def source_reason(pages: DataFrame, cfg: PolicyConfig = PolicyConfig(), keys=("path",)) -> DataFrame:
    """Why a source is (or is not) a film scan."""
    return source_facts(pages, keys).select(*keys, _reason(cfg).alias("scan_reason"))


def source_kind(pages: DataFrame, cfg: PolicyConfig = PolicyConfig(), keys=("path",)) -> DataFrame:
    """Reason, kind (raw / final / NULL) and bit depth per source."""
    return (
        source_facts(pages, keys).withColumn("scan_reason", _reason(cfg))
        .withColumn("kind", _kind(F.col("scan_reason")))
        .select(*keys, "scan_reason", "kind", "bits", "software"))


def master_kind(tokens, software, camera, scanner_software=fv.SCANNER_SOFTWARE) -> Column:
    """The scan kind of an existing master from its tokens and software."""
    listed = T.clean(tokens)
    verdict = F.get(F.filter(T.values_of(tokens, fv.SCAN), lambda v: v != ""), F.lit(0))
    mask = F.exists(
        T.values_of(tokens, fv.SUBFILETYPE),
        lambda v: F.coalesce(whole_number(F.trim(v)).bitwiseAND(F.lit(4)) != 0, F.lit(False)))
    plain = F.regexp_replace(
        F.coalesce(_col(software), F.lit("")), fv.LONE_RECORD_SEGMENT_PATTERN, "")
    unnamed = F.regexp_replace(plain, r"[ |]", "") == ""
    from_tiff = F.exists(listed, lambda t: t.startswith(fv.ORIGIN + "tiff"))
    return (
        F.when(verdict == "no", F.lit(None).cast("string"))
        .when(verdict.isNotNull(), verdict)
        .when(mask | _names_any(_col(software), scanner_software)
              | (from_tiff & unnamed & ~_col(camera)), F.lit("unknown")))


def assign_distance(kind, bits, cfg: PolicyConfig = PolicyConfig()) -> Column:
    """The quality target of one asset."""
    run = F.lit(float(cfg.distance))
    if cfg.eight_bit == "same":
        eight = float(cfg.distance)
    elif cfg.eight_bit == "auto":
        eight = 0.0 if cfg.distance <= fv.EIGHT_BIT_LOSSLESS_UP_TO else float(cfg.distance)
    else:
        eight = float(cfg.eight_bit)
    kind, bits = _col(kind), F.coalesce(_col(bits), F.lit(0))
    result = F.when(kind.isNull() & (bits > 0) & (bits <= 8), F.lit(eight))
    if cfg.scan_distance is not None:
        covered = kind.isNotNull() if cfg.scan_scope == "all" else (kind == "raw")
        result = F.when(
            F.coalesce(covered, F.lit(False)), F.lit(float(cfg.scan_distance))).otherwise(
                F.coalesce(result, run))
        return result
    return F.coalesce(result, run)


def _thumbnails_wanted(cfg: PolicyConfig) -> Column:
    if cfg.thumbnail_mode == "include":
        return F.lit(True)
    if cfg.thumbnail_mode == "auto":
        return ~_names_any(F.col("_software"), cfg.thumbnail_drop)
    if cfg.thumbnail_mode == "scans":
        return F.col("_kind").isNotNull()
    return F.lit(False)


def _thumbnail_facts(pages: DataFrame, cfg: PolicyConfig, keys) -> DataFrame:
    return source_kind(pages, cfg, keys).select(
        *keys, F.col("software").alias("_software"), F.col("kind").alias("_kind"))


def _keep_thumbnail(cfg: PolicyConfig) -> Column:
    encodable = F.lit(True) if cfg.thumbnail_mode == "include" else F.coalesce(
        F.col("photometric"), F.lit(2)).isin(*fv.ENCODABLE_PHOTOMETRICS)
    return _thumbnails_wanted(cfg) & encodable


def kept_thumbnails(pages: DataFrame, cfg: PolicyConfig = PolicyConfig(),
                    keys=("path",)) -> DataFrame:
    """The thumbnail pages the policy encodes (input flag ``is_thumb``)."""
    thumbs = pages.filter("is_thumb")
    if cfg.thumbnail_mode in ("include", "exclude"):
        return thumbs.filter(_keep_thumbnail(cfg)) if cfg.thumbnail_mode == "include" else (
            thumbs.filter(F.lit(False)))
    joined = skew.attach(thumbs, _thumbnail_facts(pages, cfg, keys), list(keys))
    return joined.filter(_keep_thumbnail(cfg)).drop("_software", "_kind")


def page_output_name(stem, page, is_thumb, single, suffix: str = fv.THUMBNAIL_SUFFIX,
                     extension: str = ".jxl") -> Column:
    """The file name of one planned page."""
    stem, page = _col(stem), _col(page)
    numbered = F.when(page == 0, stem).otherwise(
        F.concat(stem, F.lit("_page"), page.cast("string")))
    paged = F.concat(numbered, F.when(_col(is_thumb), F.lit(suffix)).otherwise(F.lit("")))
    return F.concat(F.when(_col(single), stem).otherwise(paged), F.lit(extension))


def plan_pages(pages: DataFrame, cfg: PolicyConfig = PolicyConfig(), keys=("path",),
               stem: str = "stem") -> DataFrame:
    """Which pages become outputs and under which names.

    One input row per (source, page) with ``is_thumb``; per-source counts come
    back through a join, so a source with very many pages is never one task.
    """
    keys = list(keys)
    facts = pages.groupBy(*keys).agg(
        F.count_if(~F.col("is_thumb")).alias("_real"),
        F.count_if(F.col("is_thumb")).alias("_thumbs"))
    rows = skew.attach(pages, facts, keys)
    first = F.col("page") == 0
    if cfg.page_mode == "ignore":
        chosen = rows.filter(first).withColumn("is_thumb", F.lit(False))
    elif cfg.page_mode == "skip":
        chosen = rows.filter(
            ((F.col("_real") == 1) & ~F.col("is_thumb"))
            | ((F.col("_real") == 0) & (F.col("_thumbs") > 0) & first))
    elif cfg.page_mode == "split_all" or (
            cfg.page_mode == "split" and cfg.thumbnail_mode == "include"):
        chosen = rows
    elif cfg.page_mode == "split" and cfg.thumbnail_mode == "exclude":
        chosen = rows.filter(~F.col("is_thumb"))
    elif cfg.page_mode == "split":
        chosen = (
            skew.attach(rows, _thumbnail_facts(pages, cfg, keys), keys)
            .filter(~F.col("is_thumb") | _keep_thumbnail(cfg))
            .drop("_software", "_kind"))
    else:
        raise ValueError(f"unknown page mode: {cfg.page_mode}")
    planned = chosen.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("planned_pages"),
        F.max("is_thumb").alias("_any_thumb"))
    out = skew.attach(chosen, planned, keys)
    single = (F.col("planned_pages") == 1) & ~F.col("_any_thumb")
    return (
        out.withColumn("output_name", page_output_name(
            stem, "page", "is_thumb", single, cfg.thumbnail_suffix))
        .drop("_real", "_thumbs", "_any_thumb"))


def unarchivable(pages: DataFrame, tags: DataFrame | None = None, keys=("path",)) -> DataFrame:
    """Content an archive would not keep as it is, first reason per source.

    ``pages`` brings ``bits_per_sample array<int>``; ``tags`` one row per
    private tag with ``page, code, type, size``.  Without ``tags`` each row of
    ``pages`` brings one tag of its page itself, and is read once.
    """
    keys = list(keys)
    candidate = (
        (F.col("code") >= 32768) & ~F.col("code").isin(*fv.PRIVATE_TAG_SKIP)
        & ~F.col("code").isin(fv.IPTC_TAG, fv.RESOURCES_TAG)
        & F.col("type").isin(*fv.PRIVATE_TAG_TYPES) & (F.col("size") > fv.PRIVATE_TAG_MAX_BYTES))
    layers = F.col("code") == fv.LAYERS_TAG
    odd = F.exists("bits_per_sample", lambda b: ~b.isin(8, 16))
    # Lowest page first; on one page layers, then oversized tags, then samples.
    by_tag, by_depth = F.when(layers, F.lit(0)).when(candidate, F.lit(1)), F.when(odd, F.lit(2))
    if tags is None:
        found = pages.select(*keys, "page", F.coalesce(by_tag, by_depth).alias("step")).filter("step IS NOT NULL")
    else:
        found = (
            tags.select(*keys, "page", by_tag.alias("step")).filter("step IS NOT NULL")
            .unionByName(pages.select(*keys, "page", by_depth.alias("step")).filter("step IS NOT NULL")))
    # Page and step as one number: its least needs a hash table, where the least of a struct sorts all rows.
    # An unknown page comes first.
    first = F.coalesce(F.col("page").cast("long"), F.lit(-1 << 40)) * 4 + F.col("step")
    return (
        found.select(*keys, first.alias("_at")).groupBy(*keys).agg(F.min("_at").alias("_first"))
        .withColumn("unarchivable", F.element_at(F.array(
            F.lit("layers"), F.lit("private tag too large"), F.lit("sample depth")),
            F.pmod(F.col("_first"), F.lit(4)).cast("int") + 1))
        .drop("_first"))


def output_depth(depth, is_thumb, policy: str = "preserve_thumbnails") -> Column:
    """Sample depth of a restored page; an unrecorded depth reads as 16."""
    depth = _col(depth)
    if policy == "force16":
        return F.lit(16)
    if policy == "preserve_original":
        return F.coalesce(depth, F.lit(16))
    return F.when(_col(is_thumb) & (depth == 8), F.lit(8)).otherwise(F.lit(16))


# -- re-encode decisions ----------------------------------------------------------


def classify_reencode(recorded_d, recorded_e, distance, effort, floor=fv.DISTANCE_FLOOR) -> Column:
    """Ok / downgrade / unknown for a re-encode request."""
    d, e = _col(recorded_d), _col(recorded_e)
    want_d = F.lit(float(distance)) if not isinstance(distance, (str, Column)) else _col(distance)
    want_e = F.lit(int(effort)) if not isinstance(effort, (str, Column)) else _col(effort)

    def effective(x):
        return F.when(x > 0, F.greatest(x, F.lit(float(floor)))).otherwise(F.lit(0.0))

    return (
        F.when(d.isNull() | e.isNull(), F.lit("unknown"))
        .when((d == 0) & (want_d == 0),
              F.when(want_e > e, F.lit("ok")).otherwise(F.lit("downgrade")))
        .when(effective(want_d) > effective(d), F.lit("ok"))
        .otherwise(F.lit("downgrade")))


_RANKED_ACTIONS = ("convert", "ask", "copy", "skip")  # least to most conservative


def action_rank(action) -> Column:
    return F.array_position(F.array(*[F.lit(a) for a in _RANKED_ACTIONS]), _col(action)).cast("int")


def most_conservative(*actions) -> Column:
    """The safest of several actions; NULL ones do not take part."""
    ranked = [F.when(_col(a).isNotNull(), action_rank(a)) for a in actions]
    best = F.greatest(*ranked) if len(ranked) > 1 else ranked[0]
    return F.element_at(F.array(*[F.lit(a) for a in _RANKED_ACTIONS]), best)


def hidden_generations(origin) -> Column:
    """One unrecorded lossy step when the first master came out of one."""
    return F.coalesce(_col(origin).isin(*fv.HIDDEN_LOSS_ORIGINS), F.lit(False)).cast("int")


def base_action(category, has_jbrd, cfg: DeriveConfig) -> Column:
    by_category = (
        F.when(_col(category) == "ok", F.lit("convert"))
        .when(_col(category) == "downgrade", F.lit(cfg.on_downgrade))
        .otherwise(F.lit(cfg.on_unknown)))
    if cfg.jbrd_policy == "convert":
        return by_category
    return F.when(_col(has_jbrd), F.lit(cfg.jbrd_policy)).otherwise(by_category)


def regeneration_action(gen, origin, distance, cfg: DeriveConfig) -> Column:
    """The guard for a repeated lossy generation, NULL when it does not apply."""
    repeated = (_col(gen) + hidden_generations(origin)) >= 2
    want = F.lit(float(distance)) if not isinstance(distance, (str, Column)) else _col(distance)
    return F.when(repeated & (want > 0), F.lit(cfg.on_regeneration))


def scan_action(kind, distance, cfg: DeriveConfig) -> Column:
    """The guard for film scans, NULL when it does not apply."""
    if cfg.label is not None:
        return F.lit(None).cast("string")
    want = F.lit(float(distance)) if not isinstance(distance, (str, Column)) else _col(distance)
    covered = _col(kind).isNotNull()
    if cfg.scan_scope == "raw":
        covered = covered & (_col(kind) != "final")
    return F.when(covered & (want > 0), F.lit(cfg.on_scan))


def resolve_action(df: DataFrame, cfg: DeriveConfig = DeriveConfig(), distance=None,
                   category="category", has_jbrd="has_jbrd", gen="gen", origin="origin",
                   kind="kind") -> DataFrame:
    """P20: policies combined, the most conservative one wins."""
    want = cfg.distance if distance is None else distance
    base = base_action(category, has_jbrd, cfg)
    regen = regeneration_action(gen, origin, want, cfg)
    scan = scan_action(kind, want, cfg)
    return df.withColumn("action", most_conservative(base, regen, scan)).withColumn(
        "guards", F.concat_ws(
            "+",
            F.when(_col(has_jbrd) & F.lit(cfg.jbrd_policy != "convert"), F.lit("jbrd")),
            F.when(regen.isNotNull(), F.lit("regeneration")),
            F.when(scan.isNotNull(), F.lit("scan"))))


def settle_actions(df: DataFrame, derived: bool = False, attended: bool = False,
                   is_thumb: str | None = None) -> DataFrame:
    """What an unattended run does with open questions and copies."""
    action = F.col("action")
    if not attended:
        action = F.when(action == "ask", F.lit("skip")).otherwise(action)
    if derived:
        action = F.when(action == "copy", F.lit("skip")).otherwise(action)
        if is_thumb is not None:
            action = F.when(F.col(is_thumb), F.lit("skip")).otherwise(action)
    return df.withColumn("action", action)


# -- routes and keep reasons ---------------------------------------------------------


def route_assets(df: DataFrame, boxes: DataFrame | None = None, force: str | None = None,
                 path: str = "path", ext: str = "ext") -> DataFrame:
    """The route of each asset; ``boxes`` brings (path, has_jbrd)."""
    if boxes is not None:
        df = df.join(boxes.select(F.col("path").alias(path), "has_jbrd"), path, "left")
    jbrd = F.coalesce(F.col("has_jbrd"), F.lit(False))
    kind = F.lower(F.col(ext))
    is_jxl = kind == ".jxl"
    if force == "transcode":
        route = F.when(is_jxl, F.lit("recover")).otherwise(F.lit("lossless"))
    elif force == "convert":
        route = F.when(is_jxl, F.lit("decode")).otherwise(F.lit("convert"))
    else:
        route = (
            F.when(kind.isin(*fv.JPEG_EXTENSIONS), F.lit("lossless"))
            .when(kind == ".png", F.lit("convert"))
            .when(is_jxl & jbrd, F.lit("recover"))
            .when(is_jxl, F.lit("decode"))
            .otherwise(F.lit("error")))
    return df.withColumn("route", route)


def decode_is_lossy(info, frames_kept=False) -> Column:
    """Why a 16-bit integer decode is not a full copy, from the image info text."""
    line = F.regexp_extract(F.coalesce(_col(info), F.lit("")), r"(?m)^(JPEG XL (?:image|animation),[^\n]*)", 1)
    kept = F.lit(frames_kept) if isinstance(frames_kept, bool) else frames_kept
    bits = F.nullif(F.regexp_extract(line, r"\b(\d+)-bit\b", 1), F.lit("")).try_cast("int")
    return (
        F.when(line == "", F.lit(None).cast("string"))
        .when(line.startswith("JPEG XL animation") & ~kept, F.lit("animation"))
        .when(line.contains("float"), F.lit("float samples"))
        .when(bits > 16, F.concat(bits.cast("string"), F.lit("-bit samples"))))


def keep_reason(src_ext, dest_ext, png_depth, gain_map, has_jbrd, reduced=None) -> Column:
    """Why a lossy conversion must keep its source, NULL when it need not."""
    src, dst = F.lower(_col(src_ext)), F.lower(_col(dest_ext))
    reduced = F.lit(None).cast("string") if reduced is None else _col(reduced)
    from_jxl = src == ".jxl"
    png = from_jxl & (dst == ".png")
    from_jpeg = src.isin(*fv.JPEG_EXTENSIONS) & (dst == ".jxl") & ~F.coalesce(
        _col(has_jbrd), F.lit(False))
    return (
        F.when(from_jxl & dst.isin(*fv.JPEG_EXTENSIONS), F.lit("lossy jpeg decode"))
        .when(png & (F.coalesce(_col(png_depth), F.lit(0)) != 16), F.lit("png below 16 bits"))
        .when(png & reduced.isNotNull(), F.lit("reduced samples"))
        .when(from_jpeg & _col(gain_map).isNotNull(), F.lit("gain map not carried")))


def one_direction(plan: DataFrame, deletes: bool, decode_asked: bool = False,
                  only: str | None = None, route: str = "route", ext: str = "ext") -> DataFrame:
    """A deleting plan acts in the encode direction unless decode was asked for."""
    is_jxl = F.lower(F.col(ext)) == ".jxl"
    if only == "from_jxl":
        return plan.filter(is_jxl)
    if only == "from_jpeg":
        plan = plan.filter(F.lower(F.col(ext)) != ".png")
    if deletes and not decode_asked:
        plan = plan.filter(~is_jxl)
    return plan


def encode_facts(df: DataFrame, description: str, software: str, history: str) -> DataFrame:
    """Recorded parameters of a master out of its three record homes.

    ``history`` is an array column.  Adds ``recorded_d``, ``recorded_e``, ``gen``.
    """
    staged = (
        df.withColumn("_entry", R.settling_entry(F.col(history)))
        .withColumn("_record", R.record_or_stop("_entry")))
    staged = R.with_merged_chain(staged, description, software, "_record", "_chain")
    # The newest entry is the record; a malformed one makes it unknown.
    staged = staged.withColumn("_chain", F.transform("_chain", lambda x: F.struct(
        recorded_number(x["d"]).alias("d"), x["e"].try_cast("int").alias("e")))).withColumn(
            "_last", F.try_element_at("_chain", F.lit(-1)))
    counted = F.size(F.filter("_chain", lambda x: F.coalesce(x["d"] > 0, F.lit(False))))
    return (
        staged.withColumn("recorded_d", F.col("_last.d"))
        .withColumn("recorded_e", F.when(F.col("_last.d").isNotNull(), F.col("_last.e")))
        .withColumn("gen", F.greatest(
            R.merged_stored_gen(F.col(description), F.col(software), F.col("_record")), counted))
        .drop("_entry", "_record", "_chain", "_last"))
