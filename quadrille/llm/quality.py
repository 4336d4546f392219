"""Quality rules: adaptive thresholds from mergeable quantile sketches.

Each document gets a few integer metrics. Per language and source, and for each metric, a sketch counts the
documents by bucket. A bucket keeps the leading ``SKETCH_BITS`` bits of the metric, so a quantile is off by at most
1/64 of its value; sketches of parts merge by adding counts, in any order and with one result. A document is rejected
when a metric lies beyond the fence that its group's quartiles set. Groups with fewer than ``min_rows`` documents use
the merged sketch of their language, and languages with fewer use that of the corpus.

Only DataFrame and SQL functions are used. Texts never move: only their metrics and the sketches' counts do.

Defined cases: a null text counts as empty, and fails the base rule. Null languages or sources form groups of their
own. Repeated rows are judged alike, each on its own. Empty tables give empty results. Input columns named like a
result column are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import MAX_BROADCAST_ROWS, SPACE_CLASS, SPACES, materialize, others, text_or_empty

SYMBOLS = "#*$%&|<>"
SKETCH_BITS = 7
#: Metrics in units of 1/10,000 (word length: of 1/1,000), the slack by which a fence lies beyond the quartile at
#: least, and whether low values are rejected too.
METRICS = {"symbols": (500, False), "dup_lines": (3500, False), "repeats": (3000, False), "word_len": (2000, True)}
SPREAD = 4
MIN_ROWS = 30
STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_INDEX_BITS = 20


def _let(value: str, name: str, body: str) -> str:
    """SQL that evaluates value once and binds it to name in body."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def repeat_words(words: str) -> str:
    """SQL: of the array of words, how many lie in windows of three that occur twice or more.

    Windows are compared as 44 bits of a 64-bit hash packed with their position, so one sort of longs finds the
    repeats. Where two different windows share a hash, or the text has 2^20 words, windows are compared as texts."""
    low = (1 << _INDEX_BITS) - 1
    grams = "transform(sequence(0, size(w) - 3), i -> concat_ws(' ', w[i], w[i + 1], w[i + 2]))"
    packed = f"sort_array(transform(sequence(0L, size(w) - 3L), i -> (xxhash64(w[int(i)], w[int(i) + 1], w[int(i) + 2]) & {~low}L) | i))"
    near = f"filter(h, (x, k) -> coalesce((x ^ get(h, k - 1)) & {~low}L = 0, false) OR coalesce((x ^ get(h, k + 1)) & {~low}L = 0, false))"
    covered = "aggregate(transform(p, (x, k) -> coalesce(least(3L, get(p, k + 1) - x), 3L)), 0L, (a, b) -> a + b)"
    exact = _let(
        f"array_sort(transform({grams}, (g, i) -> struct(g, i)))", "s",
        _let("sort_array(transform(filter(s, (x, k) -> coalesce(x.g = get(s, k - 1).g, false) OR coalesce(x.g = get(s, k + 1).g, false)), x -> bigint(x.i)))", "p", covered),
    )
    honest = (
        f"size(array_distinct(transform(f, x -> shiftright(x, {_INDEX_BITS})))) = "
        f"size(array_distinct(transform(f, x -> concat_ws(' ', w[int(x & {low}L)], w[int(x & {low}L) + 1], w[int(x & {low}L) + 2]))))"
    )
    fast = _let(packed, "h", _let(near, "f", f"CASE WHEN size(f) = 0 THEN 0L WHEN {honest} THEN {_let(f'sort_array(transform(f, x -> x & {low}L))', 'p', covered)} ELSE {exact} END"))
    return _let(words, "w", f"CASE WHEN size(w) < 4 THEN 0L WHEN size(w) >= {low} THEN {exact} ELSE {fast} END")


def with_stats(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs and the base statistics of each whole text, and ``n_lines``, its lines that hold a word."""
    df = docs.select(*others(docs, [*STATS, "n_lines"]), text_or_empty(text_col).alias("__q_text"))
    df = df.withColumn("__q_words", F.array_remove(F.split("__q_text", f"{SPACE_CLASS}+"), ""))
    lines = F.filter(F.split("__q_text", "\n"), lambda x: F.length(F.translate(x, SPACES, "")) > 0)
    df = df.withColumn("__q_lines", lines)
    size = F.length("__q_text")
    return df.select(
        *[F.col(f"`{c}`") for c in df.columns if not c.startswith("__q_")],
        F.size("__q_words").cast("long").alias("n_words"),
        F.length(F.translate("__q_text", SPACES, "")).cast("long").alias("word_chars"),
        (size - F.length(F.translate("__q_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("__q_lines") - F.size(F.array_distinct("__q_lines"))).cast("long").alias("n_dup_lines"),
        F.expr(repeat_words("__q_words")).alias("n_repeat_words"),
        F.size("__q_lines").cast("long").alias("n_lines"),
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _metrics() -> dict[str, Column]:
    words = F.greatest(F.col("n_words"), F.lit(1))
    div = lambda a, b: F.floor(a / b).cast("long")
    whole = {"symbols": ("n_symbols", words, 10_000), "dup_lines": ("n_dup_lines", F.greatest(F.col("n_lines"), F.lit(1)), 10_000), "repeats": ("n_repeat_words", words, 10_000), "word_len": ("word_chars", words, 1_000)}
    return {k: div(F.col(a) * scale, b) for k, (a, b, scale) in whole.items()}


def bucket(value: Column) -> Column:
    """The lower end of the value's bucket in a sketch."""
    drop = F.greatest(F.lit(0), F.length(F.bin(value)) - SKETCH_BITS)
    size = F.pow(F.lit(2.0), drop).cast("long")
    return F.floor(value / size).cast("long") * size


def sketches(scored: DataFrame) -> DataFrame:
    """(lang, source, metric, bucket, n) of the documents that pass the base rule."""
    parts = F.array(*[F.struct(F.lit(k).alias("metric"), bucket(F.col(f"__q_m_{k}")).alias("bucket")) for k in METRICS])
    return scored.where("not base_failed").select("__q_lang", "__q_source", F.explode(parts).alias("x")).groupBy("__q_lang", "__q_source", "x.metric", "x.bucket").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, min_rows: int = MIN_ROWS, spread: int = SPREAD) -> DataFrame:
    """Per language and source the lowest and highest value of each metric that is kept."""
    lang, source, rest = F.col("__q_lang"), F.col("__q_source"), [F.col("metric"), F.col("bucket")]
    sets = sketch.groupingSets([[lang, source, *rest], [lang, *rest], rest], lang, source, *rest)
    merged = sets.agg((F.grouping("__q_source") + F.grouping("__q_lang")).alias("level"), F.sum("n").alias("n"))
    keys = ["level", "__q_lang", "__q_source", "metric"]
    ordered = merged.selectExpr("*", f"sum(n) OVER (PARTITION BY {', '.join(keys)} ORDER BY bucket) AS upto", f"sum(n) OVER (PARTITION BY {', '.join(keys)}) AS total")
    quartile = lambda q: F.min(F.when(F.col("upto") * 4 >= F.col("total") * q, F.col("bucket")))
    found = ordered.groupBy(*keys).agg(quartile(1).alias("q1"), quartile(3).alias("q3"), F.max("total").alias("n"))
    slack = F.create_map(*[F.lit(x) for k, (s, _) in METRICS.items() for x in (k, s)])[F.col("metric")]
    two_sided = F.col("metric").isin([k for k, (_, both) in METRICS.items() if both])
    reach = F.greatest(slack.cast("long"), spread * (F.col("q3") - F.col("q1")))
    fences = found.select(*keys, "n", F.when(two_sided, F.col("q1") - reach).otherwise(F.lit(0)).alias("low"), (F.col("q3") + reach).alias("high"))
    wide = fences.groupBy("level", "__q_lang", "__q_source").agg(F.max("n").alias("n"), *[F.max(F.when(F.col("metric") == k, F.col(x))).alias(f"{x}_{k}") for k in METRICS for x in ("low", "high")])
    cols = [f"{x}_{k}" for k in METRICS for x in ("low", "high")]
    own = wide.where("level = 0").alias("own")
    by_lang = wide.where("level = 1").select(F.col("__q_lang").alias("l_lang"), F.col("n").alias("l_n"), *[F.col(c).alias(f"l_{c}") for c in cols])
    of_all = wide.where("level = 2").select(*[F.col(c).alias(f"a_{c}") for c in cols])
    joined = own.join(by_lang, F.col("__q_lang").eqNullSafe(F.col("l_lang")), "left").join(F.broadcast(of_all), how="left", on=F.lit(True))
    pick = lambda c: F.when(F.col("n") >= min_rows, F.col(c)).when(F.col("l_n") >= min_rows, F.col(f"l_{c}")).otherwise(F.col(f"a_{c}"))
    return joined.select(F.col("__q_lang").alias("t_lang"), F.col("__q_source").alias("t_source"), *[pick(c).alias(c) for c in cols])


def judge(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", keep: list[str] | None = None, min_rows: int = MIN_ROWS, spread: int = SPREAD) -> DataFrame:
    """One row per input row: the columns in keep (all by default), the statistics, ``base_failed`` and ``kept``.

    The metrics are written once to the shared folder; the sketches and the verdicts both read them there. The
    thresholds are broadcast if their number is at most ``MAX_BROADCAST_ROWS``; beyond it they are joined by shuffle,
    each dealt to 16 salted copies so that a source with a third of all rows meets 16 tasks."""
    keep = docs.columns if keep is None else keep
    kept_cols = [c for c in keep if c.lower() not in {*STATS, "n_lines", "base_failed", "kept"}]
    base = docs.select(*[F.col(f"`{c}`") for c in kept_cols], F.col(lang_col).alias("__k_lang"), F.col(source_col).alias("__k_source"), F.col(text_col).alias("__k_text"))
    df = with_stats(base, "__k_text").withColumn("base_failed", base_failed())
    df = df.select(*[F.col(f"`{c}`") for c in kept_cols], *STATS, "n_lines", "base_failed", F.col("__k_lang").alias("__q_lang"), F.col("__k_source").alias("__q_source"), *[v.alias(f"__q_m_{k}") for k, v in _metrics().items()])
    scored = materialize(df, "quality")
    limits = materialize(thresholds(sketches(scored), min_rows, spread), "thresholds")
    if limits.count() <= MAX_BROADCAST_ROWS:
        same = F.col("__q_lang").eqNullSafe(F.col("t_lang")) & F.col("__q_source").eqNullSafe(F.col("t_source"))
        out = scored.join(F.broadcast(limits), same, "left")
    else:
        salts = 16
        limits = limits.withColumn("t_salt", F.explode(F.array(*map(F.lit, range(salts)))))
        salted = scored.withColumn("__q_salt", F.pmod(F.xxhash64("n_words", "word_chars", "n_lines"), F.lit(salts)).cast("int"))
        same = F.col("__q_lang").eqNullSafe(F.col("t_lang")) & F.col("__q_source").eqNullSafe(F.col("t_source")) & (F.col("__q_salt") == F.col("t_salt"))
        out = salted.join(limits, same, "left")
    ok = ~F.col("base_failed")
    for k in METRICS:
        ok = ok & F.col(f"__q_m_{k}").between(F.col(f"low_{k}"), F.col(f"high_{k}"))
    return out.select(*[F.col(f"`{c}`") for c in kept_cols], *STATS, "n_lines", "base_failed", F.coalesce(ok, F.lit(False)).alias("kept"))


def keep_good(docs: DataFrame, **kw) -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns."""
    clash = {x.lower() for x in (*STATS, "n_lines", "base_failed", "kept")}
    names = {c: f"__c_{i}" if c.lower() in clash else c for i, c in enumerate(docs.columns)}
    df = judge(docs.withColumnsRenamed({a: b for a, b in names.items() if a != b}), **kw)
    return df.where("kept").select(*[F.col(f"`{b}`").alias(a) for a, b in names.items()])


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return judge(docs, keep=["doc_id"]).select("doc_id", *STATS, "base_failed", "kept")


_CASES = ", ".join(f"max(CASE WHEN metric = '{k}' THEN {x} END) AS {x}_{k}" for k in METRICS for x in ("low", "high"))
_PICK = ", ".join(f"CASE WHEN o.n >= {MIN_ROWS} THEN o.{x}_{k} WHEN l.n >= {MIN_ROWS} THEN l.{x}_{k} ELSE a.{x}_{k} END AS {x}_{k}" for k in METRICS for x in ("low", "high"))
ORACLE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS tri FROM (SELECT rid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
r AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, tri) AS c FROM g) WHERE c > 1),
rw AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j FROM r) GROUP BY rid),
s AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(rw.n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN rw ON w.rid = rw.rid),
b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    n_symbols * 10000 // greatest(n_words, 1) AS symbols, n_dup_lines * 10000 // greatest(n_lines, 1) AS dup_lines,
    n_repeat_words * 10000 // greatest(n_words, 1) AS repeats, word_chars * 1000 // greatest(n_words, 1) AS word_len FROM s),
m AS ({" UNION ALL ".join(f"SELECT lang, source, '{k}' AS metric, {k} AS v FROM b WHERE NOT base_failed" for k in METRICS)}),
k AS (SELECT lang, source, metric, (v // z) * z AS bucket FROM (SELECT *, (2 ** greatest(0, length(bin(v)) - {SKETCH_BITS}))::BIGINT AS z FROM m)),
c AS (SELECT 0 AS level, lang, source, metric, bucket, count(*) AS n FROM k GROUP BY ALL UNION ALL
    SELECT 1, lang, NULL, metric, bucket, count(*) FROM k GROUP BY ALL UNION ALL SELECT 2, NULL, NULL, metric, bucket, count(*) FROM k GROUP BY ALL),
u AS (SELECT *, sum(n) OVER (PARTITION BY level, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY level, lang, source, metric) AS total FROM c),
q AS (SELECT level, lang, source, metric, min(bucket) FILTER (upto * 4 >= total) AS q1, min(bucket) FILTER (upto * 4 >= total * 3) AS q3, max(total) AS n FROM u GROUP BY ALL),
f AS (SELECT level, lang, source, metric, n, CASE metric {" ".join(f"WHEN '{k}' THEN {'q1 - greatest(' + str(s) + f', {SPREAD} * (q3 - q1))' if both else '0'}" for k, (s, both) in METRICS.items())} END AS low,
    q3 + greatest(CASE metric {" ".join(f"WHEN '{k}' THEN {s}" for k, (s, _) in METRICS.items())} END, {SPREAD} * (q3 - q1)) AS high FROM q),
t AS (SELECT level, lang, source, max(n) AS n, {_CASES} FROM f GROUP BY ALL),
x AS (SELECT o.lang, o.source, {_PICK} FROM (SELECT * FROM t WHERE level = 0) o
    LEFT JOIN (SELECT * FROM t WHERE level = 1) l ON o.lang IS NOT DISTINCT FROM l.lang LEFT JOIN (SELECT * FROM t WHERE level = 2) a ON true)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
    coalesce(NOT base_failed AND {" AND ".join(f"b.{k} BETWEEN x.low_{k} AND x.high_{k}" for k in METRICS)}, false) AS kept
FROM b LEFT JOIN x ON b.lang IS NOT DISTINCT FROM x.lang AND b.source IS NOT DISTINCT FROM x.source
"""
