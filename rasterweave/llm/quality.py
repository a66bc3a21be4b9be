"""Quality rules with adaptive thresholds, in DataFrame functions only.

Every document gets counts over its whole text. Each rate of those that pass the base rules feeds a mergeable quantile
sketch per language and source: a table of counts over log-linear integer buckets (256 to a power of two, so a
quantile is off by under 0.4 %). Sketches merge by adding counts, on the map side first, so a source that holds a third of all rows sends one
row a bucket and task. The quartiles and the 1 % and 99 % quantiles of a group are blended with those of its language,
which are blended with those of the corpus: a group of n documents counts n times, what is above it PRIOR times. No
constant stands for a rate. A fence is an outer quartile and SPREAD times a scale: the distance of the quartiles, or,
where they are equal (most documents have none of what is counted), half the way to the 1 % or 99 % quantile.
The fences are then joined to the documents. Windows of words are compared by 64-bit hashes.

Defined results: null text counts as empty; a text without words has zero counts and fails the base rules; a group
none of whose documents passes them has no fences; null language or source is a group of its own; repeated rows count
each time and get the same verdict; an empty table gives an empty result; extra columns are ignored (verdicts) or
passed on (keep), whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import checkpointed, col, joined, kept, quoted, table

WINDOW = 8
#: Rates per thousand (of characters for r_upper and r_letters), and whether there is a lower fence.
RULES = {"r_symbols": False, "r_dup_lines": False, "r_repeat": False, "r_upper": False, "r_letters": True, "r_word_chars": True}
SPREAD, PRIOR = 5, 10
BASE_FAILED = "__n_words < 20 or 100 * __n_repeat_words > 30 * __n_words"


def counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with `__n_words`, `__word_chars`, `__n_symbols`, `__n_lines`, `__n_dup_lines`, `__n_repeat_words`,
    `__n_upper` and `__n_letters` appended (long)."""
    df = docs.withColumn("__t", F.coalesce(col(text).cast("string"), F.lit("")))
    df = df.withColumn("__w", F.expr(r"array_remove(split(__t, '[ \\t-\\r]+'), '')"))
    df = df.withColumn("__l", F.expr(r"filter(split(__t, '\n'), l -> l rlike '[^ \\t-\\r]')"))
    df = df.withColumn("__hw", F.expr("transform(__w, w -> xxhash64(w))"))
    at = ", ".join(f"__hw[i + {k}]" for k in range(WINDOW))
    n = "cast(size(__w) as int)"
    df = df.withColumn("__h", F.expr(f"if({n} > {WINDOW}, transform(sequence(0, greatest({n} - {WINDOW}, 0)), i -> xxhash64({at})), array())"))
    df = df.withColumn("__s", F.expr("if(size(array_distinct(__h)) < size(__h), sort_array(transform(__h, (x, i) -> struct(x, i))), null)"))
    df = df.withColumn(
        "__p",
        F.expr(
            "sort_array(filter(transform(__s, (e, k) -> if((k > 0 and get(__s, k - 1).x = e.x)"
            " or (k + 1 < size(__s) and get(__s, k + 1).x = e.x), e.i, null)), p -> p is not null))"
        ),
    )
    left = lambda chars: f"cast(char_length(__t) - char_length({chars}) as bigint)"
    return df.selectExpr(
        *map(quoted, docs.columns),
        "cast(size(__w) as bigint) as __n_words",
        "cast(aggregate(__w, 0L, (a, w) -> a + char_length(w)) as bigint) as __word_chars",
        left("regexp_replace(__t, '[#*$%&|<>]', '')") + " as __n_symbols",
        "cast(size(__l) as bigint) as __n_lines",
        "cast(size(__l) - size(array_distinct(__l)) as bigint) as __n_dup_lines",
        f"coalesce(aggregate(__p, struct(0L as n, -{WINDOW} as z), (a, p) -> struct(a.n + least({WINDOW}, p - a.z) as n, p as z), a -> a.n), 0L) as __n_repeat_words",
        left("regexp_replace(__t, '[A-Z]', '')") + " as __n_upper",
        left(r"regexp_replace(__t, '\\p{L}', '')") + " as __n_letters",
    )


def _rates(df: DataFrame) -> DataFrame:
    per = lambda a, b: F.expr(f"if({b} > 0, (1000 * {a}) div {b}, null)")
    return df.withColumns(
        {
            "r_symbols": per("__n_symbols", "__n_words"),
            "r_dup_lines": per("__n_dup_lines", "__n_lines"),
            "r_repeat": per("__n_repeat_words", "__n_words"),
            "r_upper": per("__n_upper", "__word_chars"),
            "r_letters": per("__n_letters", "__word_chars"),
            "r_word_chars": per("__word_chars", "__n_words"),
        }
    )


def sketch(rates: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, bucket, n): the mergeable sketch; a bucket stands as its least value."""
    rows = rates.select(*keys, F.expr("stack({}, {}) as (metric, v)".format(len(RULES), ", ".join(f"'{m}', {m}" for m in RULES)))).where("v is not null")
    rows = rows.withColumn("s", F.expr("greatest(0, length(bin(v)) - 9)")).withColumn("bucket", F.expr("shiftleft(shiftright(v, s), s)"))
    return rows.groupBy(*keys, "metric", "bucket").agg(F.count(F.lit(1)).alias("n"))


#: The quantiles of a sketch that fences are made of, as fractions.
QUANTILES = {"head": (1, 100), "q1": (1, 4), "q3": (3, 4), "tail": (99, 100)}


def quantiles(sk: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, n, head, q1, q3, tail) of every sketch."""
    by = Window.partitionBy(*keys, "metric")
    run = sk.withColumn("c", F.sum("n").over(by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))).withColumn("t", F.sum("n").over(by))
    at = [F.min(F.when(F.col("c") * down >= F.col("t") * up, F.col("bucket"))).alias(q) for q, (up, down) in QUANTILES.items()]
    return run.groupBy(*keys, "metric").agg(F.max("t").alias("n"), *at)


def thresholds(rates: DataFrame, keys: tuple[str, str], spread: int = SPREAD, prior: int = PRIOR) -> DataFrame:
    """(lang, source, __own, __lo_*, __hi_*): the fences of each group, and the per cent that its own quantiles count."""
    lang, source = keys
    own = checkpointed(sketch(rates.where(f"not ({BASE_FAILED})").select(F.col(lang).alias("lang"), F.col(source).alias("source"), *RULES), ["lang", "source"]))
    merged = lambda k, p: quantiles(own.groupBy(*k, "metric", "bucket").agg(F.sum("n").alias("n")), k).select(*[F.col(c).alias(f"{p}{c}") for c in [*k, "metric", "n", *QUANTILES]])
    got = quantiles(own, ["lang", "source"])
    got = joined(got, checkpointed(merged(["lang"], "l_")), [("lang", "l_lang"), ("metric", "l_metric")], "inner")
    got = got.join(F.broadcast(merged([], "a_")), F.col("metric") == F.col("a_metric"))  # a row a metric
    blend = lambda q: f"(n * {q} + {prior} * ((l_n * l_{q} + {prior} * a_{q}) div (l_n + {prior}))) div (n + {prior})"
    got = got.selectExpr("lang", "source", "metric", "n", *[f"{blend(q)} as {q}" for q in QUANTILES])
    wide = lambda rest: f"if(q3 > q1, {spread} * (q3 - q1), ({spread} * ({rest})) div 2)"
    one = lambda m, e: F.max(F.when(F.col("metric") == m, F.expr(e)))
    aggs = [F.max(F.expr(f"(100 * n) div (n + {prior})")).alias("__own")]
    for m, two_sided in RULES.items():
        aggs.append(one(m, f"q1 - {wide('q1 - head')}" if two_sided else "cast(-1 as bigint)").alias(f"__lo_{m}"))
        aggs.append(one(m, f"q3 + {wide('tail - q3')}").alias(f"__hi_{m}"))
    return got.groupBy("lang", "source").agg(*aggs)


def verdicts(docs: DataFrame, text: str = "text", keys: tuple[str, str] = ("lang", "source"), spread: int = SPREAD, keep_columns: list[str] | None = None) -> DataFrame:
    """The counts of every row of docs (columns `keep_columns`) with `__base_failed` and `__kept`.

    The counts are computed once and kept as a few numbers a row; the text moves nowhere."""
    cols = keep_columns if keep_columns is not None else docs.columns
    own = docs.select(*[col(c).alias(f"__k_{c}") for c in cols], col(keys[0]).alias("__lang"), col(keys[1]).alias("__source"), col(text).alias("__text"))
    rates = _rates(checkpointed(counts(own, "__text").drop("__text")))
    got = _judged(rates, checkpointed(thresholds(rates, ("__lang", "__source"), spread)), ("__lang", "__source"))
    return got.select(*[col(f"__k_{c}").alias(c) for c in cols], *[c for c in got.columns if c.startswith("__") and not c.startswith("__k_")])


def _judged(rates: DataFrame, limits: DataFrame, keys: tuple[str, str]) -> DataFrame:
    got = joined(rates, limits.withColumnsRenamed({"lang": "__tl", "source": "__ts"}), [(keys[0], "__tl"), (keys[1], "__ts")])
    fine = " and ".join(f"({m} is null or {m} between __lo_{m} and __hi_{m})" for m in RULES)
    got = got.withColumn("__base_failed", F.expr(BASE_FAILED))
    return got.withColumn("__kept", F.expr(f"not __base_failed and coalesce({fine}, true)"))


def keep(docs: DataFrame, text: str = "text", keys: tuple[str, str] = ("lang", "source"), spread: int = SPREAD) -> DataFrame:
    """docs without the rows that the rules reject, with the columns of docs.

    Every text is counted once: the rows and their counts are kept as a table in the shared folder, the sketches read
    its counts only, and no text is shuffled."""
    own = docs.select(*[col(c).alias(f"__k{i}") for i, c in enumerate(docs.columns)], col(keys[0]).alias("__lang"), col(keys[1]).alias("__source"), col(text).alias("__text"))
    rates = _rates(kept(counts(own, "__text").drop("__text")))
    limits = checkpointed(thresholds(rates, ("__lang", "__source"), spread))
    return _judged(rates, limits, ("__lang", "__source")).where("__kept").select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(docs.columns)])


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = verdicts(table(spark, sf_dir, "documents"), keep_columns=["doc_id"])
    own = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return got.select("doc_id", *[F.col(f"__{c}").alias(c) for c in own], F.col("__own").alias("own_share"))


def _quantile_sql(name: str, keys: str) -> str:
    by = f"{keys}, metric" if keys else "metric"
    at = ", ".join(f"min(bucket) filter (c * {down} >= t * {up}) as {q}" for q, (up, down) in QUANTILES.items())
    return f"""
  {name}_s as (select {by}, bucket, sum(n)::bigint as n from sk group by {by}, bucket),
  {name}_c as (select *, sum(n) over (partition by {by} order by bucket) as c, sum(n) over (partition by {by}) as t from {name}_s),
  {name} as (select {by}, max(t)::bigint as n, {at} from {name}_c group by {by})"""


def _sql() -> str:
    fine = " and ".join(f"({m} is null or {m} between lo_{m} and hi_{m})" for m in RULES)
    blend = ", ".join(f"(g.n * g.{q} + {PRIOR} * ((l.n * l.{q} + {PRIOR} * a.{q}) // (l.n + {PRIOR}))) // (g.n + {PRIOR}) as {q}" for q in QUANTILES)
    wide = lambda rest: f"case when q3 > q1 then {SPREAD} * (q3 - q1) else ({SPREAD} * ({rest})) // 2 end"
    ends = ", ".join(f"max(case when metric = '{m}' then {'q1 - ' + wide('q1 - head') if two_sided else '-1'} end) as lo_{m}, max(case when metric = '{m}' then q3 + {wide('tail - q3')} end) as hi_{m}" for m, two_sided in RULES.items())
    return rf"""
with d as (select row_number() over () as rid, doc_id, lang, source, coalesce(text, '') as t from documents),
  w as (select *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') as ws, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
  g8 as (select rid, i, array_to_string(ws[i:i + 7], ' ') as g from (select rid, ws, unnest(range(1, len(ws) - 6)) as i from w where len(ws) >= 8)),
  rep as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 8)) as p from (select rid, i, count(*) over (partition by rid, g) as k from g8) where k > 1) group by rid),
  m as (select w.rid, doc_id, lang, source, len(ws)::bigint as n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::bigint as word_chars,
      (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, len(ls)::bigint as n_lines,
      (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(rep.n, 0)::bigint as n_repeat_words,
      (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')))::bigint as n_upper, (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))::bigint as n_letters
    from w left join rep on rep.rid = w.rid),
  r as (select *, case when n_words > 0 then 1000 * n_symbols // n_words end as r_symbols, case when n_lines > 0 then 1000 * n_dup_lines // n_lines end as r_dup_lines,
      case when n_words > 0 then 1000 * n_repeat_words // n_words end as r_repeat, case when word_chars > 0 then 1000 * n_upper // word_chars end as r_upper,
      case when word_chars > 0 then 1000 * n_letters // word_chars end as r_letters, case when n_words > 0 then 1000 * word_chars // n_words end as r_word_chars from m),
  v as ({' union all '.join(f"select lang, source, '{m}' as metric, {m} as v from r where {m} is not null and not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)" for m in RULES)}),
  b as (select lang, source, metric, v, greatest(0, length(ltrim(bin(v), '0')) - 9) as s from v),
  sk as (select lang, source, metric, (v >> s) << s as bucket, count(*) as n from b group by all),
{_quantile_sql('qg', 'lang, source')}, {_quantile_sql('ql', 'lang')}, {_quantile_sql('qa', '')},
  q as (select g.lang, g.source, g.metric, g.n, {blend} from qg g join ql l on l.lang is not distinct from g.lang and l.metric = g.metric join qa a on a.metric = g.metric),
  f as (select lang, source, max(100 * n // (n + {PRIOR}))::bigint as own, {ends} from q group by lang, source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 20 or 100 * n_repeat_words > 30 * n_words) as base_failed,
  (not (n_words < 20 or 100 * n_repeat_words > 30 * n_words)) and coalesce({fine}, true) as kept, own as own_share
from r left join f on f.lang is not distinct from r.lang and f.source is not distinct from r.source"""


SQL = _sql()
