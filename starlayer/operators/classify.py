"""Text tagging and the process × dimension bus matrix (P01–P06).

Lexicon matching reads each *whole* text once (``functions.keywords``: an
automaton over Arrow batches, four times as fast as a substring search per
keyword); what it finds are word numbers, and all rules on them are column
expressions: a narrow map without join or shuffle. The lexicon is fixed and
small (about a hundred keywords), so its size does not grow with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from starlayer.functions import lexicon as L
from starlayer.functions.joins import with_scalars
from starlayer.functions.keywords import found_words


def _found(df: DataFrame, id_col: str, text_col: str, lexicon: dict[str, list[str]], entities: list[str]) -> DataFrame:
    """id, ``_words`` (places in the lexicon's keywords, one list after the other,
    matched without case) and ``_entities`` (matched as they are)."""
    words = [w.lower() for kws in lexicon.values() for w in kws]
    entity = found_words(F.col(text_col), entities) if entities else F.array().cast("array<int>")
    return df.select(F.col(id_col), found_words(F.lower(text_col), words).alias("_words"), entity.alias("_entities"))


def _own(lexicon: dict[str, list[str]]) -> dict[str, Column]:
    """Per entry of the lexicon the places of its keywords that were found."""
    out, lo = {}, 0
    for name, kws in lexicon.items():
        out[name] = _between(lo, lo + len(kws))
        lo += len(kws)
    return out


def _between(lo: int, hi: int) -> Column:
    return F.filter("_words", lambda w: (w >= lo) & (w < hi))


def tag_business_process(df: DataFrame, id_col: str, text_col: str, min_confidence: float = 0.5,
                         known: list[str] | None = None, lexicon: dict | None = None,
                         entities: list[str] | None = None) -> DataFrame:
    """P01 (+P06 when ``known`` is given) — processes whose keyword list hits.

    ``evidence_keywords`` are the keywords found, in the lexicon's order (none
    for a process that is only known).
    confidence = min(0.5 + 0.15·hits, 0.95); a known process that was not hit
    is added at 0.7, one that was hit gains 0.2 (at most 0.99); with e entity
    words present: max(c − 0.05·e, 0.3); rows below ``min_confidence`` drop.
    Keywords match case-insensitively, entity words case-sensitively.
    Arithmetic is in double in the same order as the rule, so boundary values
    behave identically.
    """
    lexicon = lexicon or L.PROCESS_KEYWORDS
    entities = entities if entities is not None else L.ENTITY_HINTS
    known = known or []
    procs = list(lexicon) + [k for k in known if k not in lexicon]
    own = _own(lexicon)
    words = F.array(*[F.lit(w) for kws in lexicon.values() for w in kws])
    counted = _found(df, id_col, text_col, lexicon, entities).select(
        id_col, F.array(*[own.get(p, F.array().cast("array<int>")) for p in procs]).alias("_h"), F.size("_entities").alias("entity_hits"))
    names = F.array(*[F.lit(p) for p in procs])
    # the outer form: the array always has one slot per process, and no filter
    # is inferred that would search the texts again
    base = counted.select(id_col, "entity_hits", F.posexplode_outer("_h").alias("_pos", "_w")) \
        .withColumn("process", F.element_at(names, F.col("_pos") + 1)).withColumn("hits", F.size("_w")) \
        .withColumn("evidence_keywords", F.transform("_w", lambda w: F.element_at(words, w + 1)))
    hits = F.col("hits")
    c = F.least(F.lit(0.5) + F.lit(0.15) * hits.cast("double"), F.lit(0.95))
    is_known = F.col("process").isin(*known) if known else F.lit(False)
    c = F.when(is_known & (hits == 0), F.lit(0.7)).when(is_known, F.least(c + F.lit(0.2), F.lit(0.99))).otherwise(c)
    e = F.col("entity_hits")
    c = F.when(e > 0, F.greatest(c - F.lit(0.05) * e.cast("double"), F.lit(0.3))).otherwise(c)
    out = base.filter((hits > 0) | is_known).select(id_col, "process", "hits", "entity_hits", c.alias("confidence"), "evidence_keywords")
    return out.filter(F.col("confidence") >= F.lit(min_confidence)) \
        .withColumn("confidence", F.round("confidence", 4))


def process_known_boost(df: DataFrame, id_col: str, text_col: str, known: list[str],
                        min_confidence: float = 0.5) -> DataFrame:
    """P06 — P01 with the caller's known processes."""
    return tag_business_process(df, id_col, text_col, min_confidence, known=known)


def tag_data_domain(df: DataFrame, id_col: str, text_col: str, lexicon: dict | None = None) -> DataFrame:
    """P02 — domain with the most keyword hits per text; ties go to the earlier
    domain of the lexicon; no hit → ``uncategorized``. One projection."""
    lexicon = lexicon or L.DOMAIN_KEYWORDS
    structs = [F.struct(F.size(own).alias("hits"), F.lit(-rank).alias("neg_rank"), F.lit(dom).alias("domain"))
               for rank, (dom, own) in enumerate(_own(lexicon).items())]
    best = F.array_max(F.array(*structs))
    return _found(df, id_col, text_col, lexicon, []).select(F.col(id_col), best.alias("_b")).select(
        id_col, F.when(F.col("_b.hits") > 0, F.col("_b.domain")).otherwise("uncategorized").alias("domain"),
        F.col("_b.hits").alias("hits"))


def domain_summary(tags: DataFrame, lexicon: dict | None = None, warn_domains: int = 3) -> DataFrame:
    """P05 — rows per domain, the primary domain (most rows, ties by lexicon
    order), a warning when ≥ 3 domains occur, and the uncategorized rows as
    errors. The per-domain frame has at most |lexicon| + 1 rows, so the final
    ranking window over it is tiny."""
    lexicon = lexicon or L.DOMAIN_KEYWORDS
    order = {d: i for i, d in enumerate(lexicon)}
    rank = F.lit(len(order))
    for dname, i in order.items():
        rank = F.when(F.col("domain") == dname, F.lit(i)).otherwise(rank)
    per = tags.groupBy("domain").agg(F.count(F.lit(1)).alias("rows")).withColumn("_r", rank)
    w = Window.partitionBy()
    cat = F.col("domain") != "uncategorized"
    best = F.max(F.when(cat, F.struct(F.col("rows"), -F.col("_r")))).over(w)
    return per.select(
        "domain", "rows",
        (cat & (F.struct(F.col("rows"), -F.col("_r")) == best)).alias("is_primary"),
        F.sum(F.when(cat, 1).otherwise(0)).over(w).alias("domains"),
        (F.sum(F.when(cat, 1).otherwise(0)).over(w) >= warn_domains).alias("warning"),
        F.coalesce(F.sum(F.when(~cat, F.col("rows"))).over(w), F.lit(0)).cast("bigint").alias("uncategorized_errors"))


def bus_matrix_long(facts: DataFrame, process_col: str, dims: dict[str, DataFrame]) -> DataFrame:
    """P03 (long form) — for each process and dimension: how many distinct
    non-NULL keys of the process rows resolve in the dimension, and ``used``.

    ``facts`` has one column per dimension key (named like the dimension);
    ``dims`` maps a dimension name to a one-column frame of its keys. One pass
    over the facts: the key columns are unpivoted with ``stack`` and reduced
    to distinct (process, dimension, key) — bounded by the dimension sizes, not
    the fact size — then left-joined to the union of dimension keys.
    """
    names = list(dims)
    pairs = ", ".join(f"'{d}', CAST(`{d}` AS STRING)" for d in names)
    stacked = facts.selectExpr(f"`{process_col}` AS process",
                               f"stack({len(names)}, {pairs}) AS (dimension, _key)").distinct()
    keys = None
    for d, frame in dims.items():
        k = frame.select(F.lit(d).alias("dimension"), F.col(frame.columns[0]).cast("string").alias("_dkey"))
        keys = k if keys is None else keys.unionByName(k)
    keys = keys.dropna().distinct()
    j = stacked.join(keys, (stacked["dimension"] == keys["dimension"]) & (stacked["_key"] == keys["_dkey"]), "left")
    return (j.groupBy("process", stacked["dimension"])
            .agg(F.countDistinct("_dkey").alias("resolved_keys"))
            .withColumn("used", F.col("resolved_keys") > 0))


def bus_matrix_wide(rows: DataFrame, uses: dict[str, tuple[Column, dict[str, str]]], dims: dict[str, DataFrame]) -> DataFrame:
    """P03 (long form) from rows that serve several processes at once.

    ``uses`` names each process with the condition under which a row belongs to
    it and the columns that hold its keys: ``{process: (condition, {dimension:
    column})}``. A row gives one entry per (dimension, column) with a flag per
    process, not one per process and dimension; flags of equal keys are merged on
    the map side, so what is shuffled is bounded by the keys. Same result as
    :func:`bus_matrix_long`: processes with a row, every dimension of ``dims``, 0
    where a process has no column or only NULLs.
    """
    flags = {p: f"_p{i}" for i, p in enumerate(uses)}
    columns = dict.fromkeys((d, c) for _, keys in uses.values() for d, c in keys.items() if d in dims)
    if not columns:
        raise ValueError("no process uses any of the dimensions")
    entries = F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(f"`{c}`").cast("string").alias("_key"),
                 *[(F.coalesce(cond, F.lit(False)) if keys.get(d) == c else F.lit(False)).alias(flags[p])
                   for p, (cond, keys) in uses.items()])
        for d, c in columns])
    any_flag = F.greatest(*[F.col(f) for f in flags.values()]) if len(flags) > 1 else F.col("_p0")
    keyed = (rows.select(F.inline(entries)).where(any_flag).groupBy("dimension", "_key")
             .agg(*[F.bool_or(f).alias(f) for f in flags.values()]))
    known = None
    for d, frame in dims.items():
        k = frame.select(F.lit(d).alias("_dim"), F.col(frame.columns[0]).cast("string").alias("_dkey"))
        known = k if known is None else known.unionByName(k)
    known = known.dropna().distinct()
    j = keyed.join(known, (keyed["dimension"] == known["_dim"]) & (keyed["_key"] == known["_dkey"]), "left")
    per = j.groupBy("dimension").agg(*[
        F.struct(F.count(F.when(F.col(f), F.col("_dkey"))).alias("n"), F.bool_or(f).alias("seen")).alias(f)
        for f in flags.values()])  # a row per dimension from here on
    seen = per.select("dimension", F.inline(F.array(*[
        F.struct(F.lit(p).alias("process"), F.col(f"{f}.n").alias("n"), F.col(f"{f}.seen").alias("seen"))
        for p, f in flags.items()]))).where("seen")
    by = seen.groupBy("process").agg(F.map_from_entries(F.collect_list(F.struct("dimension", "n"))).alias("_by"))
    return (by.select("process", F.inline(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.coalesce(F.try_element_at("_by", F.lit(d)), F.lit(0)).alias("resolved_keys"))
        for d in dims]))).withColumn("used", F.col("resolved_keys") > 0))


def bus_matrix(long: DataFrame, dims: list[str]) -> DataFrame:
    """P03 — pivot to process × dimension booleans (values listed, so the pivot
    needs no extra pass to discover them)."""
    return long.groupBy("process").pivot("dimension", dims).agg(F.max("used"))


def bus_matrix_shared(long: DataFrame) -> DataFrame:
    """P04 — per dimension: processes using it, shared by all, and the only
    process when exactly one uses it."""
    n = long.select("process").distinct().agg(F.count(F.lit(1)).alias("_np"))
    g = long.groupBy("dimension").agg(F.count(F.when(F.col("used"), 1)).alias("processes_using"),
                                      F.max(F.when(F.col("used"), F.col("process"))).alias("_any"))
    j = with_scalars(g, n)
    return j.select("dimension", "processes_using", (F.col("processes_using") == F.col("_np")).alias("shared"),
                    F.when(F.col("processes_using") == 1, F.col("_any")).alias("only_process"))
