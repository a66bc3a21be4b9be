"""Secret scans: spans of credential-like strings, and corpus-wide ownership frequency of their values.

Each text is scanned once. A value (the assigned string, the key, the digits) is known to the corpus step by its hash
only. Hashes are counted by distinct repositories and owners, duplicates removed first and counts combined before each
shuffle: a value that EXAMPLE_OWNERS owners or EXAMPLE_REPOS repositories or more hold is a widely copied example, a
value with few distinct characters or with a placeholder word is a placeholder, and the rest are live-looking
credentials of their owners.

Base kinds are assign, access and hex. Further kinds have formats of their own: pem (private key blocks), jwt, github,
slack and google keys.

Defined results: null text counts as empty and has no spans; null ids and owners count as one repository or owner
each; repeated rows each get their row, and count once for the frequency; an empty table gives an empty result; extra
columns are ignored (scan) or passed on (redaction), whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpointed, col, joined, quoted, table

EXAMPLE_OWNERS, EXAMPLE_REPOS = 3, 100
#: Fixed patterns of the base kinds, with the least length of the value.
BASE = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 24),
}
MORE = {
    "pem": (re.compile(r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----(?:[^-]|-[^-])*-----END [A-Z ]{0,20}PRIVATE KEY-----"), 0, 64),
    "jwt": (re.compile(r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"), 0, 30),
    "github": (re.compile(r"gh[opsu]_[A-Za-z0-9]+"), 0, 40),
    "slack": (re.compile(r"xox[abps]-[A-Za-z0-9-]+"), 0, 20),
    "google": (re.compile(r"AIza[A-Za-z0-9_-]+"), 0, 39),
}
KINDS = {**BASE, **MORE}
_ORDER = {k: i for i, k in enumerate(KINDS)}
#: What a text must hold, in lower case where the kind takes either case, for a kind's pattern to match.
_NEEDS = {
    "access": (b"AKIA",), "pem": (b"PRIVATE KEY-----",), "jwt": (b"eyJ",), "github": (b"gho_", b"ghp_", b"ghs_", b"ghu_"),
    "slack": (b"xox",), "google": (b"AIza",),
}
_NEEDS_LOWER = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_HEX = bytes(120 if 48 <= b <= 57 or 97 <= b <= 102 else 32 for b in range(256))
_HEX_RUN = b"x" * 24
_PLACEHOLDER = re.compile(r"example|change_?me|placeholder|your[_-]|dummy|sample|redacted|xxxx|^[0-9]{1,10}$", re.I | re.A)


def find(raw: bytes | None) -> list[tuple[str, int, int, int, int, str]]:
    """(kind, start, end, start and end of the value, value) in code points, by start and then kind."""
    if not raw:
        return []
    kinds = [k for k, needs in _NEEDS.items() if any(x in raw for x in needs)]
    low = raw.translate(_LOWER)
    if any(x in low for x in _NEEDS_LOWER):
        kinds.append("assign")
    if _HEX_RUN in raw.translate(_HEX):
        kinds.append("hex")
    if not kinds:
        return []
    text = raw.decode("utf-8", "replace")
    found = []
    for kind in kinds:
        pattern, group, least = KINDS[kind]
        for m in pattern.finditer(text):
            if len(m[group]) >= least:
                found.append((kind, *m.span(), *m.span(group), m[group]))
    return sorted(found, key=lambda x: (x[1], _ORDER[x[0]]))


def value_hash(value: str) -> str:
    return hashlib.sha256(value.encode()).hexdigest()[:32]


def placeholder(value: str) -> bool:
    return len(set(value)) < 5 or bool(_PLACEHOLDER.search(value))


_FOUND = "array<struct<kind:string,s:int,e:int,h:string,p:boolean>>"
_FOUND_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("s", pa.int32()), ("e", pa.int32()), ("h", pa.string()), ("p", pa.bool_())]))


def scanned(docs: DataFrame, text: str = "__text", out: str = "__found") -> DataFrame:
    """docs with the column `text` replaced by `out`, the spans found: array of kind, s, e, h (value hash), p (placeholder)."""
    rest = [c for c in docs.columns if c != text]
    schema = docs.select(*rest, F.lit(None).cast(_FOUND).alias(out)).schema

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            got = [[{"kind": k, "s": s, "e": e, "h": value_hash(v), "p": placeholder(v)} for k, s, e, _, _, v in find(t.as_py())] for t in b.column(text).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in rest] + [pa.array(got, _FOUND_ARROW)], names=[*rest, out])

    return docs.mapInArrow(batches, schema)


def ownership(found: DataFrame, repo: str, owner: str, examples: int = EXAMPLE_OWNERS) -> DataFrame:
    """(h, n_repos, n_owners, verdict) of every value in found (columns repo, owner, __found)."""
    each = found.select(F.col(repo).cast("string").alias("repo"), F.col(owner).cast("string").alias("owner"), F.explode("__found").alias("x"))
    each = each.select("x.h", "x.p", "owner", "repo").distinct()
    # A row each distinct owner and each distinct repository of a value; a repository under two owners is one.
    sides = lambda c: each.groupBy("h", c).agg(F.max("p").alias("p")).select("h", "p", *[F.lit(int(c == x)).alias(f"n_{x}s") for x in ("repo", "owner")])
    got = sides("repo").union(sides("owner")).groupBy("h").agg(F.sum("n_repos").alias("n_repos"), F.sum("n_owners").alias("n_owners"), F.max("p").alias("p"))
    verdict = F.when((F.col("n_owners") >= examples) | (F.col("n_repos") >= EXAMPLE_REPOS), "example").when(F.col("p"), "placeholder").otherwise("live")
    return got.select("h", "n_repos", "n_owners", verdict.alias("verdict"))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str | None = None, owner: str = "source", examples: int = EXAMPLE_OWNERS) -> DataFrame:
    """One row per row of docs: doc_id, found (array of kind, s, e, h, verdict, n_repos, n_owners) in span order."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(repo or doc_id).alias("__repo"), F.col(owner).alias("__owner"), F.col(text).cast("string").alias("__text"))
    own = checkpointed(scanned(own).withColumn("__row", F.monotonically_increasing_id()))
    known = checkpointed(ownership(own, "__repo", "__owner", examples))
    each = own.where(F.size("__found") > 0).select("__row", "doc_id", F.posexplode("__found").alias("i", "x"))
    each = joined(each.select("__row", "doc_id", "i", "x.*"), known.withColumnRenamed("h", "kh"), [("h", "kh")])
    kinds = F.struct("i", "kind", "s", "e", "h", "verdict", "n_repos", "n_owners")
    some = each.groupBy("__row").agg(F.first("doc_id").alias("doc_id"), F.sort_array(F.collect_list(kinds)).alias("found")).select("doc_id", "found")
    none = own.where(F.size("__found") == 0).select("doc_id", F.array().cast(some.schema["found"].dataType).alias("found"))
    return some.union(none)


def redacted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", repo: str | None = None, owner: str = "source", n_chars: str | None = "n_chars", examples: int = EXAMPLE_OWNERS) -> DataFrame:
    """docs with the value of every live-looking credential replaced by <kind>, and n_chars counted anew.

    Values cross the corpus as hashes; a document with live values is met by its id and text hash."""
    key = lambda df: (col(doc_id).cast("string").alias("__id"), F.xxhash64(F.coalesce(col(text).cast("string"), F.lit(""))).alias("__h"))
    own = docs.select(*key(docs), col(repo or doc_id).alias("__repo"), col(owner).alias("__owner"), col(text).cast("string").alias("__text"))
    own = checkpointed(scanned(own).where(F.size("__found") > 0))
    known = ownership(own, "__repo", "__owner", examples).where("verdict = 'live'").select(F.col("h").alias("kh"))
    each = own.select("__id", "__h", F.explode("__found.h").alias("h")).distinct()
    live = joined(each, checkpointed(known), [("h", "kh")], "inner").groupBy("__id", "__h").agg(F.collect_set("h").alias("__live"))
    rows = docs.select(*key(docs), F.struct(*[col(c) for c in docs.columns if c != text] or [F.lit(True).alias("none")]).alias("__row"), col(text).cast("string").alias("__text"))
    rows = joined(rows, checkpointed(live), [("__id", "__id"), ("__h", "__h")]).select("__row", "__text", "__live")

    def batches(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            texts = [redact(t.as_py(), set(x)) if x else t.as_py() for t, x in zip(b.column(1).cast(pa.binary()), b.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.binary()).cast(pa.string())], names=["__row", "__text"])

    got = rows.where("__live is not null").mapInArrow(batches, rows.select("__row", "__text").schema).withColumn("__new", F.lit(True))
    got = got.union(rows.where("__live is null").select("__row", "__text", F.lit(False)))
    kind = docs.schema[n_chars].dataType if n_chars in docs.columns else None
    old = lambda c: F.col(f"__row.{quoted(c)}")
    back = lambda c: F.when(F.col("__new"), F.length("__text").cast(kind)).otherwise(old(c)) if c == n_chars else old(c)
    return got.select(*[(F.col("__text") if c == text else back(c)).alias(c) for c in docs.columns])


def redact(raw: bytes, live: set[str]) -> bytes:
    """The text with the values of the given hashes replaced by their kind; overlapping values go together."""
    text, out, done = raw.decode("utf-8", "replace"), [], 0
    for kind, _, _, s, e, v in sorted(find(raw), key=lambda x: (x[3], -x[4])):
        if value_hash(v) in live and e > done:
            if s >= done:
                out += [text[done:s], f"<{kind}>"]
            done = e
    return "".join([*out, text[done:]]).encode()


def op7_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = scan(table(spark, sf_dir, "documents"))
    joins = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["s"], x["e"])), ",")
    many = lambda field, v: F.size(F.filter("found", lambda x: x[field] == v)).cast("long")
    base = F.filter("found", lambda x: x["kind"].isin(*BASE))
    return got.select(
        "doc_id",
        *[many("kind", k).alias(f"n_{k}") for k in BASE],
        F.sha2(joins(base), 256).alias("base_sha256"),
        joins("found").alias("spans"),
        many("verdict", "live").alias("n_live"),
        many("verdict", "example").alias("n_example"),
        F.coalesce(F.array_max(F.transform("found", lambda x: x["n_owners"])), F.lit(0)).cast("long").alias("most_owners"),
    )


def _sql() -> str:
    """Spans from the texts between matches; the ownership of values by their MD5, which tells as well which are equal."""
    patterns = {
        "assign": (r"""(?i)(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", r"""(?i)^(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
        **{k: (KINDS[k][0].pattern, "") for k in KINDS if k != "assign"},
    }
    q = lambda x: "'" + x.replace("'", "''") + "'"
    each = " union all ".join(
        f"select rid, doc_id, source, '{k}' as kind, {i} as o, {KINDS[k][2]} as least, {q(head)} as head, regexp_extract_all(t, {q(p)}) as ms, string_split_regex(t, {q(p)}) as ps from d where regexp_matches(t, {q(p)})"
        for i, (k, (p, head)) in enumerate(patterns.items())
    )
    listed = lambda where: f"coalesce(string_agg(kind || ':' || s || ':' || e, ',' order by s, o){where}, '')"
    return f"""
with d as (select row_number() over () as rid, doc_id, source, coalesce(text, '') as t from documents),
  k as ({each}),
  m as (select * exclude (ms, ps), unnest(range(1, len(ms) + 1)) as i, ms, ps from k),
  p as (select rid, doc_id, source, kind, o, least, ms[i] as x, if(head = '', ms[i], regexp_replace(ms[i], head, '')) as v,
      list_sum(list_transform(ps[1:i], lambda z: length(z)))::bigint + coalesce(list_sum(list_transform(ms[1:i - 1], lambda z: length(z))), 0)::bigint as s from m),
  f as (select *, s + length(x) as e, md5(v) as h, len(list_distinct(string_split(v, ''))) < 5 or regexp_matches(v, {q("(?i)" + _PLACEHOLDER.pattern)}) as ph from p where length(v) >= least),
  own as (select h, count(distinct coalesce(doc_id::varchar, 'null')) as repos, count(distinct coalesce(source, 'null')) as owners, bool_or(ph) as ph from f group by h),
  j as (select f.*, repos, owners, case when owners >= {EXAMPLE_OWNERS} or repos >= {EXAMPLE_REPOS} then 'example' when own.ph then 'placeholder' else 'live' end as verdict from f join own using (h)),
  g as (select rid, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k in BASE)}, {listed(" filter (kind in ('assign', 'access', 'hex'))")} as base, {listed('')} as spans,
      count(*) filter (verdict = 'live') as n_live, count(*) filter (verdict = 'example') as n_example, max(owners) as most from j group by rid)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k in BASE)}, sha256(coalesce(base, '')) as base_sha256, coalesce(spans, '') as spans,
  coalesce(n_live, 0)::bigint as n_live, coalesce(n_example, 0)::bigint as n_example, coalesce(most, 0)::bigint as most_owners from d left join g using (rid)"""


SQL = _sql()
