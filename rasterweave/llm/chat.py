"""Chat formatting with typed content parts, in DataFrame functions only.

A message's content is an array of parts of type text, image, audio or document. A visitor folds over the parts: texts
that follow one another are joined and escaped, any other part becomes the placeholder of its type, and its reference
and expanded token count are recorded in order. A conversation's messages are joined by turn as

    <|im_start|>role\\ntext<|im_end|>\\n

with loss spans (code points) over the contents of assistant messages.

Escaping is reversible: a control string in a text (any <|name|>, <s>, </s>, [INST], [/INST], with k >= 0 backslashes
after its first character) gets one more backslash, which reading back takes away; so no text holds a control string,
and other text stays as it is. In roles, % and line ends become %25 and %0A.

Defined results: null text, null parts, null roles and parts of null or unknown type count as empty text; messages are
ordered by turn (null first), then role and content, repeated rows included; null conversation ids are one
conversation; an empty table gives an empty result; other columns are ignored. A conversation is one output row and so
is put together in one task; the texts are flattened and escaped before they are dealt out by conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import table

START, END = "<|im_start|>", "<|im_end|>\n"
#: Fixed control strings, after their first character < or [.
_CONTROL = r"(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])"
_ESCAPE = (r"([<\[])(\\*)" + _CONTROL, r"$1\\$2$3")
_UNESCAPE = (r"([<\[])\\(\\*)" + _CONTROL, r"$1$2$3")
#: Tokens that a part stands for: an image by tiles of 28 pixels, audio by 25 a second, a document by 256 a page.
IMAGE_TILE, AUDIO_RATE, PAGE_TOKENS = 28, 25, 256
PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, _ESCAPE))


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, *map(F.lit, _UNESCAPE))


def text_part(text: Column) -> Column:
    """A content of one text part."""
    none = {"ref": "string", "width": "int", "height": "int", "seconds": "double", "pages": "int"}
    return F.array(F.struct(F.lit("text").alias("type"), text.cast("string").alias("text"), *[F.lit(None).cast(t).alias(c) for c, t in none.items()]))


def _tokens(p: Column) -> Column:
    image = F.ceil(p["width"] / IMAGE_TILE) * F.ceil(p["height"] / IMAGE_TILE)
    n = F.when(p["type"] == "image", image).when(p["type"] == "audio", F.ceil(p["seconds"] * AUDIO_RATE)).otherwise(p["pages"].cast("long") * PAGE_TOKENS)
    return F.greatest(F.coalesce(n.cast("long"), F.lit(1)), F.lit(1))


def flattened(parts: Column) -> Column:
    """Struct of content (escaped text with placeholders) and attachments (kind, ref, tokens) in order."""
    media = lambda p: F.coalesce(p["type"].isin("image", "audio", "document"), F.lit(False))
    own = F.coalesce(parts, F.array().cast(PARTS))
    start = F.struct(F.lit("").alias("done"), F.lit("").alias("run"))

    def visit(a: Column, p: Column) -> Column:
        done = F.when(media(p), F.concat(a["done"], escaped(a["run"]), F.lit("<|"), p["type"], F.lit("|>"))).otherwise(a["done"])
        run = F.when(media(p), F.lit("")).otherwise(F.concat(a["run"], F.coalesce(p["text"], F.lit(""))))
        return F.struct(done.alias("done"), run.alias("run"))

    content = F.aggregate(own, start, visit, lambda a: F.concat(a["done"], escaped(a["run"])))
    found = F.transform(F.filter(own, media), lambda p: F.struct(p["type"].alias("kind"), p["ref"].alias("ref"), _tokens(p).alias("tokens")))
    return F.struct(content.alias("content"), found.alias("attachments"))


def formatted(messages: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", trained: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: conv_id, formatted, loss (array of start, length), attachments, attachment_tokens."""
    name = F.coalesce(F.col(role).cast("string"), F.lit(""))
    safe = F.replace(F.replace(escaped(name), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))
    flat = messages.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), safe.alias("role"), name.isin(*trained).alias("trained"), flattened(F.col(parts)).alias("f"))
    head = F.concat(F.lit(START), F.col("role"), F.lit("\n"))
    rows = flat.select("conv_id", "turn", "trained", "role", head.alias("head"), "f.content", "f.attachments")
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "content")  # the grouping below deals nothing out again
    size = F.length("head") + F.length("content") + len(END)
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("conv_id", F.struct(F.row_number().over(order).alias("n"), "head", "content", "trained", before.alias("at"), "attachments").alias("m"))
    rows = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    span = lambda m: F.struct((m["at"] + F.length(m["head"])).alias("start"), F.length(m["content"]).alias("length"))
    attachments = F.flatten(F.transform("ms", lambda m: m["attachments"]))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("ms", lambda m: F.concat(m["head"], m["content"], F.lit(END))), "").alias("formatted"),
        F.transform(F.filter("ms", lambda m: m["trained"]), span).alias("loss"),
        attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
    )


def read_back(text: Column) -> Column:
    """The messages of a formatted conversation: array of role, text (with placeholders)."""
    chunks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda c: c != "")

    def message(c: Column) -> Column:
        body = F.substring(c, F.lit(len(START) + 1), F.length(c))
        role = F.substring_index(body, "\n", 1)
        plain = unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))
        return F.struct(plain.alias("role"), unescaped(F.substring(body, F.length(role) + 2, F.length(body))).alias("text"))

    return F.transform(chunks, message)


def read_parts(text: Column, attachments: Column) -> Column:
    """The messages of a formatted conversation with their parts: array of role and parts (type, text, ref, tokens).

    A placeholder that is not escaped is the next attachment; texts between placeholders are text parts."""
    media = F.lit(r"<\|(image|audio|document)\|>")
    kinds = lambda m: F.regexp_extract_all(m["safe"], media, F.lit(1))
    chunks = F.filter(F.split(text, r"<\|im_end\|>\n"), lambda c: c != "")
    none = F.lit(None)

    def message(c: Column) -> Column:
        body = F.substring(c, F.lit(len(START) + 1), F.length(c))
        role = F.substring_index(body, "\n", 1)
        plain = unescaped(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))
        return F.struct(plain.alias("role"), F.substring(body, F.length(role) + 2, F.length(body)).alias("safe"))

    own = F.transform(chunks, message)

    def parts(m: Column, i: Column) -> Column:
        before = F.aggregate(F.slice(own, F.lit(1), i), F.lit(0), lambda a, x: a + F.size(kinds(x)))
        said = F.transform(F.split(m["safe"], r"<\|(?:image|audio|document)\|>", -1), unescaped)
        piece = lambda kind, said, ref, tokens: F.struct(kind.cast("string").alias("type"), said.cast("string").alias("text"), ref.cast("string").alias("ref"), tokens.cast("long").alias("tokens"))

        def at(t: Column, j: Column) -> Column:
            a = F.get(attachments, before + j - 1)
            here = F.array(piece(a["kind"], none, a["ref"], a["tokens"]), piece(F.lit("text"), t, none, none))
            return F.filter(here, lambda p: F.when(p["type"] == "text", p["text"] != "").otherwise(j > 0))

        return F.flatten(F.transform(said, at))

    return F.transform(own, lambda m, i: F.struct(m["role"].alias("role"), parts(m, i).alias("parts")))


def op6_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    odd = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    got = formatted(said.union(odd).withColumn("parts", text_part(F.col("text"))))
    got = got.withColumn("turns", read_back(F.col("formatted")))
    learnt = F.transform("loss", lambda x: unescaped(F.substring(F.col("formatted"), (x["start"] + 1).cast("int"), x["length"])))
    got = got.withColumn("learnt", F.array_join(learnt, ""))
    return got.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("learnt").cast("long").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = r"""
with m as (select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
    union all select -7, 0, 'user', '</s>[INST] ok [/INST]' union all select -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
  e as (select *, regexp_replace(text, '([<\[])(\\*)(\|[A-Za-z0-9_]+\|>|/?s>|/?INST\])', '\1\\\2\3', 'g') as safe from m)
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn nulls first, role, safe)) as turns_sha256,
  coalesce(sum(length(text)) filter (role = 'assistant'), 0)::bigint as loss_chars, sha256(coalesce(string_agg(text, '' order by turn nulls first, role, safe) filter (role = 'assistant'), '')) as loss_sha256,
  sum(12 + length(role) + 1 + length(safe) + 11)::bigint as formatted_chars
from e group by conv_id"""
