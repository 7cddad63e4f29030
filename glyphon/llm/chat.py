"""Chat formatting with typed content parts. DataFrame functions only.

A visitor walks each turn's parts in order. Text parts are escaped and joined; each
image, audio or document part becomes an ordered placeholder, and its reference and
the number of tokens it expands to are recorded. Turns are marked

    <|turn|>ROLE<|body|>TEXT<|end|>

and control strings inside roles and texts get a backslash after their first
character (one more if they have some), which is undone on the way back. The texts of
neighbouring parts are escaped together, so none can be pieced together from two parts.
A text that looks like a placeholder is escaped like a control string, so ``parse_parts``
tells the two apart.

Cases: a null text is empty, a null role or part type is empty or text; an unknown part
type is an error; turns that tie
are ordered by role, then text; repeated rows are repeated turns; a null conversation
id is one conversation; an empty table gives an empty one; further input columns are
not carried. A formatted conversation is one value, so it must fit one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
_CONTROL = r"(\||/?s>|/?INST\]|</?SYS>>)"
#: Tokens that a placeholder expands to where the part doesn't say it.
PART_TOKENS = {"image": 576, "audio": 375, "document": 1024}


def known(kind: Column) -> Column:
    """A part's type, or an error if it isn't one of ``PART_TOKENS``, so that no type can forge a control string."""
    return F.when(kind.isin(*PART_TOKENS), kind).otherwise(F.raise_error(F.concat(F.lit("unknown part type "), kind)).cast("string"))


def escape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"([<\[])(\\*)" + _CONTROL), F.lit(r"$1\\$2$3"))


def unescape(c: Column) -> Column:
    return F.regexp_replace(c, F.lit(r"([<\[])\\(\\*)" + _CONTROL), F.lit("$1$2$3"))


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), F.lit(None).cast("string").alias("ref"), F.lit(None).cast("int").alias("tokens")))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", parts: str = "parts", loss_role: str = "assistant") -> DataFrame:
    """One row a conversation: ``conv``, formatted, loss_spans, attachments, expanded_tokens.

    ``parts``: array of (type, text, ref, tokens). loss_spans: [start, end) in code points
    of ``formatted`` that hold the ``loss_role``'s texts, which are escaped there.
    """
    kind = lambda p: F.coalesce(p["type"], F.lit("text"))
    # neighbouring texts are joined before they are escaped, or a control string could be made of two of them
    hold = lambda done, text: F.struct(done.alias("done"), text.alias("text"))
    shut = lambda a: F.concat(a["done"], escape(a["text"]))

    def step(a: Column, x: Column) -> Column:
        mark = F.concat(F.lit("<|"), known(kind(x["p"])), F.lit(":"), x["i"].cast("string"), F.lit("|>"))
        return F.when(kind(x["p"]) == "text", hold(a["done"], F.concat(a["text"], F.coalesce(x["p"]["text"], F.lit(""))))).otherwise(hold(F.concat(shut(a), mark), F.lit("")))

    numbered = F.transform(F.col(parts), lambda p, i: F.struct(p.alias("p"), i.alias("i")))
    body = F.aggregate(numbered, hold(F.lit(""), F.lit("")), step, shut)
    tokens = lambda p: F.coalesce(p["tokens"], *[F.when(kind(p) == k, n) for k, n in PART_TOKENS.items()], F.lit(0)).cast("long")
    found = F.filter(F.transform(F.col(parts), lambda p, i: F.struct(i.alias("part"), kind(p).alias("type"), p["ref"].alias("ref"), tokens(p).alias("tokens"))), lambda a: a["type"] != "text")
    raw_role = F.coalesce(F.col(role), F.lit(""))
    rows = turns.select(F.col(conv), F.col(turn).alias("_turn"), raw_role.alias("_role"), F.coalesce(body, F.lit("")).alias("_body"), F.coalesce(found, F.array()).alias("_found"))
    rows = rows.withColumn("_head", F.concat(F.lit(TURN), escape(F.col("_role")), F.lit(BODY)))
    whole = F.length("_head") + F.length("_body") + len(END)
    order = Window.partitionBy(conv).orderBy("_turn", "_role", "_body", F.xxhash64("_found"))
    rows = rows.withColumn("_no", F.row_number().over(order))
    rows = rows.withColumn("_from", F.coalesce(F.sum(whole).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) + F.length("_head"))
    item = F.struct("_no", "_head", "_body", "_from", F.length("_body").alias("_len"), (F.col("_role") == loss_role).alias("_loss"), "_found")
    made = rows.groupBy(conv).agg(F.array_sort(F.collect_list(item)).alias("_turns"))
    spans = F.transform(F.filter("_turns", lambda t: t["_loss"]), lambda t: F.struct(t["_from"].alias("start"), (t["_from"] + t["_len"]).alias("end")))
    text = F.array_join(F.transform("_turns", lambda t: F.concat(t["_head"], t["_body"], F.lit(END))), "")
    refs = F.flatten(F.transform("_turns", lambda t: F.transform(t["_found"], lambda a: F.struct(t["_no"].alias("turn"), a["part"].alias("part"), a["type"].alias("type"), a["ref"].alias("ref"), a["tokens"].alias("tokens")))))
    out = made.select(conv, text.alias("formatted"), spans.alias("loss_spans"), refs.alias("attachments"))
    return out.withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def parse_chats(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, unescaped."""
    pieces = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    return F.transform(pieces, lambda x: F.struct(unescape(F.substring_index(x, BODY, 1)).alias("role"), unescape(F.substring_index(F.substring_index(x, BODY, -1), END, 1)).alias("text")))


_HELD = r"<\|(?:image|audio|document):[0-9]+\|>"


def parse_parts(body: Column) -> Column:
    """The parts (type, text, part) of a formatted body in order: a placeholder has the number of
    its part and no text, and a text between placeholders is unescaped."""
    texts, marks = F.split(body, _HELD), F.regexp_extract_all(body, F.lit(_HELD), F.lit(0))

    def one(i: Column) -> Column:
        half = F.floor(i / 2).cast("int")
        mark = F.get(marks, half)
        said = F.struct(F.lit("text").alias("type"), unescape(F.get(texts, half)).alias("text"), F.lit(None).cast("int").alias("part"))
        held = F.struct(F.regexp_extract(mark, "[a-z]+", 0).alias("type"), F.lit(None).cast("string").alias("text"), F.regexp_extract(mark, "[0-9]+", 0).cast("int").alias("part"))
        return F.when(i % 2 == 0, said).otherwise(held)

    return F.filter(F.transform(F.sequence(F.lit(0), 2 * F.size(marks)), one), lambda p: (p["type"] != "text") | (p["text"] != ""))


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between the spans."""
    cut = lambda s: unescape(formatted.substr((s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int")))
    return F.array_join(F.transform(spans, cut), "")


def op10_query(spark, sf_dir: str) -> DataFrame:
    chats = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    extra = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    made = format_chats(chats.unionByName(extra).withColumn("parts", text_parts(F.col("text"))))
    read = made.select("conv_id", parse_chats(F.col("formatted")).alias("turns"), masked_text(F.col("formatted"), F.col("loss_spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    plain = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(plain.cast("binary"), 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


def _sql_escaped(c: str) -> str:
    return rf"regexp_replace({c}, '([<\[])(\\*)(\||/?s>|/?INST\]|</?SYS>>)', '\1\\\2\3', 'g')"


OP10_SQL = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7::BIGINT, 0::BIGINT, 'user', '</s>[INST] ok [/INST]'), (-7::BIGINT, 1::BIGINT, 'assistant', '</s>[INST] ok [/INST]')
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length({_sql_escaped('role')}) + length({_sql_escaped('text')}) + {len(TURN) + len(BODY) + len(END)})::BIGINT AS formatted_chars
FROM rows GROUP BY conv_id
"""
