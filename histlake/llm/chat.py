"""Chat formatting with DataFrame operations only: budgeted windows of turns.

The template writes a turn as ``<s>role\\ntext</s>``.  Control strings inside
texts get a backslash after their first character (``<\\s>``), one more where
there are backslashes already, so that no text can open or close a turn and the
original comes back exactly.

Windows hold whole turns and at most ``budget`` tokens, all that they repeat
included.  A window begins at a turn.  Later windows repeat the system turn,
and as many of the turns just before as fit in ``history`` tokens; both are
masked, and both give way where they and the new turn exceed the budget
(history first, from its oldest turn).  Then new turns follow while the prefix
sums of their tokens stay within the budget.  So only a turn that is longer by
itself exceeds it, and such a turn stands alone.  The loss mask holds each
assistant text once, in the window where its turn is new.

One shuffle by conversation serves the window functions and the grouping; the
rest is local to a conversation: one fold over its turns chooses the windows.

Defined cases: null text or role is empty; turns with equal numbers are ordered
by role, then text; repeated rows are repeated turns; a null conv_id is one
conversation; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

# The template's marks and the control strings that texts may hold.
OPEN, CLOSE = "<s>", "</s>"
CONTROLS = r"(/?s>|/?INST\]|/?SYS>>)"
ESCAPE = (r"([<\[])(\\*)" + CONTROLS, r"$1\\$2$3")
UNESCAPE = (r"([<\[])\\(\\*)" + CONTROLS, r"$1$2$3")

BUDGET, HISTORY = 1024, 256

#: A token, where no tokeniser runs: up to four ASCII letters or digits, or one other character that is no white space.
TOKEN = r"[A-Za-z0-9]{1,4}|[^A-Za-z0-9 \t\n\x0B\f\r]"


def escape(text: Column) -> Column:
    return F.regexp_replace(text, *ESCAPE)


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, *UNESCAPE)


def escape_role(role: Column) -> Column:
    """Roles also hide line ends, which end them in the template."""
    return F.replace(F.replace(escape(role), F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(F.replace(role, F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%")))


def turn_tokens(text: Column) -> Column:
    """Tokens of a formatted turn: those of its text and the three marks around it."""
    return (F.regexp_count(text, F.lit(TOKEN)) + 3).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: Callable[[Column], Column] = turn_tokens) -> DataFrame:
    """conv_id, window, text and spans, one row for each window.

    spans: for each turn of the window, in order, struct<start, length (of the
    whole turn in the text), text_start, text_length, repeated, loss>; offsets
    count code points from 0.  ``tokens`` counts a text's tokens, marks included:
    one at least.
    """
    rows = turns.select(
        "conv_id",
        "turn",
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    rows = rows.select("*", tokens(F.col("text")).cast("long").alias("tokens"))
    ordered = W.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("*", F.row_number().over(ordered).alias("pos"), F.sum("tokens").over(ordered.rowsBetween(W.unboundedPreceding, -1)).alias("cum"))
    rows = rows.withColumn("cum", F.coalesce("cum", F.lit(0).cast("long")))
    # where the history begins, were a window to begin at this turn and have room for all of it
    recent = W.partitionBy("conv_id").orderBy("cum").rangeBetween(-history, 0)
    rows = rows.withColumn("from_pos", F.min("pos").over(recent))
    turn = F.struct("pos", "tokens", "cum", "from_pos", "role", "text")
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    marked = grouped.select("conv_id", F.transform("turns", _formatted).alias("turns"), F.transform("turns", lambda t: t["cum"]).alias("cums"))
    lead = F.element_at("turns", 1)
    marked = marked.withColumn("system", F.when(lead["role"] == "system", lead["tokens"]).otherwise(F.lit(0).cast("long")))
    cut = marked.select("conv_id", "turns", _begins(F.col("turns"), F.col("cums"), F.col("system"), budget, history).alias("begins"))
    each = F.transform("begins", lambda f, i: _window(F.col("turns"), f, F.coalesce(F.try_element_at(F.col("begins"), i + 2)["pos"], F.size("turns") + 1)))
    return cut.select("conv_id", F.posexplode(each).alias("window", "w")).select("conv_id", "window", _laid_out(F.col("w")).alias("w")).select("conv_id", "window", "w.text", "w.spans")


BEGIN = "array<struct<pos:int,back:int,system:boolean>>"


def _begins(turns: Column, cums: Column, system: Column, budget: int, history: int) -> Column:
    """pos of each window's first new turn, back (the first turn of its history) and whether it repeats the system turn.

    One fold over the turns; cums are the prefix sums of their tokens, system
    the tokens of a leading system turn or 0.
    """
    start = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(BEGIN).alias("begins"))

    def step(state: Column, t: Column) -> Column:
        retained = (system > 0) & (t["pos"] > 1) & (system + t["tokens"] <= budget)
        head = F.when(retained, system).otherwise(F.lit(0).cast("long"))
        room = F.greatest(F.least(F.lit(history), F.lit(budget) - head - t["tokens"]), F.lit(0))
        oldest = F.least(t["pos"], F.greatest(t["from_pos"], F.when(system > 0, 2).otherwise(1)))
        fits = F.filter(F.sequence(oldest, t["pos"]), lambda b: t["cum"] - F.element_at(cums, b) <= room)
        back = F.element_at(fits, 1)
        new = F.struct(t["pos"].alias("pos"), back.alias("back"), retained.alias("system"))
        begun = F.struct((head + t["cum"] - F.element_at(cums, back) + t["tokens"]).alias("used"), F.concat(state["begins"], F.array(new)).cast(BEGIN).alias("begins"))
        more = F.struct((state["used"] + t["tokens"]).alias("used"), state["begins"].alias("begins"))
        return F.when((t["pos"] == 1) | (state["used"] + t["tokens"] > budget), begun).otherwise(more)

    return F.aggregate(turns, start, step, lambda s: s["begins"])


def _formatted(t: Column) -> Column:
    head = F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit("\n"))
    body = escape(t["text"])
    return F.struct(t["pos"].alias("pos"), t["tokens"].alias("tokens"), t["cum"].alias("cum"), t["from_pos"].alias("from_pos"), t["role"].alias("role"), F.length(head).alias("head"), F.length(body).alias("body"), F.concat(head, body, F.lit(CLOSE)).alias("formatted"))


def _window(turns: Column, first: Column, end: Column) -> Column:
    """The turns of a window: the system turn, the history, the new turns."""
    part = lambda t, repeated: F.struct(t["head"].alias("head"), t["body"].alias("body"), t["formatted"].alias("formatted"), F.lit(repeated).alias("repeated"), (F.lit(not repeated) & (t["role"] == "assistant")).alias("loss"))
    begin, back = first["pos"], first["back"]
    system = F.slice(turns, 1, first["system"].cast("int"))
    past = F.concat(system, F.slice(turns, back, begin - back))
    return F.concat(F.transform(past, lambda t: part(t, True)), F.transform(F.slice(turns, begin, end - begin), lambda t: part(t, False)))


def _laid_out(parts: Column) -> Column:
    """The text of a window and its spans: offsets are prefix sums, folded once."""
    size = lambda p: p["head"] + p["body"] + len(CLOSE)
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int,text_start:int,text_length:int,repeated:boolean,loss:boolean>>").alias("spans"))
    span = lambda s, p: F.struct(s["at"].alias("start"), size(p).alias("length"), (s["at"] + p["head"]).alias("text_start"), p["body"].alias("text_length"), p["repeated"].alias("repeated"), p["loss"].alias("loss"))
    folded = F.aggregate(parts, start, lambda s, p: F.struct((s["at"] + size(p)).alias("at"), F.concat(s["spans"], F.array(span(s, p))).alias("spans")), lambda s: s["spans"])
    return F.struct(F.array_join(F.transform(parts, lambda p: p["formatted"]), "").alias("text"), folded.alias("spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss, read from the windows' texts, masks and marks."""
    cut = lambda start, length: F.substring(F.col("text"), start + 1, length)
    new = F.filter("spans", lambda s: ~s["repeated"])
    body = lambda s: F.substring(cut(s["start"], s["length"]), F.lit(len(OPEN) + 1), s["length"] - len(OPEN + CLOSE))
    role = lambda s: unescape_role(F.substring_index(body(s), "\n", 1))
    text = lambda s: unescape(F.substring(body(s), F.instr(body(s), "\n") + 1, s["length"]))
    read = formatted.select(
        "conv_id",
        "window",
        F.transform(new, lambda s: F.struct(role(s).alias("role"), text(s).alias("text"))).alias("turns"),
        F.transform(F.filter("spans", lambda s: s["loss"]), lambda s: unescape(cut(s["text_start"], s["text_length"]))).alias("loss"),
        F.length("text").cast("long").alias("chars"),
    )
    together = read.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("window", "turns", "loss"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    return together.select("conv_id", F.flatten(F.transform("w", lambda x: x["turns"])).alias("turns"), F.array_join(F.flatten(F.transform("w", lambda x: x["loss"])), "").alias("loss"), "formatted_chars")


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    said = "</s>[INST] ok [/INST]"
    extra = spark.sql("SELECT -1L AS conv_id, turn, role, text FROM VALUES (0L, 'user', :said), (1L, 'assistant', :said) AS t(turn, role, text)", args={"said": said})
    back = read_back(windows(real.unionByName(extra)))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(told, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


_ESCAPED = r"regexp_replace({0}, '([<\[])(\\*)(/?s>|/?INST\]|/?SYS>>)', '\1\\\2\3', 'g')"

#: From the rule: for every turn, what a window that began there would hold; then the chain of windows.
OP2_SQL = rf"""
WITH RECURSIVE src AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
sized AS (
  SELECT *, len(regexp_extract_all(text, '{TOKEN}')) + 3 AS tokens,
         length(replace(replace({_ESCAPED.format("role")}, '%', '%25'), chr(10), '%0A')) + length({_ESCAPED.format("text")}) + 8 AS chars
  FROM src),
placed AS (
  SELECT *, row_number() OVER o AS pos, sum(tokens) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT AS through_,
         sum(chars) OVER (o ROWS UNBOUNDED PRECEDING)::BIGINT AS upto
  FROM sized WINDOW o AS (PARTITION BY conv_id ORDER BY turn, role, text)),
led AS (
  SELECT p.*, f.role = 'system' AS has_system, f.tokens AS system_tokens, f.chars AS system_chars,
         f.role = 'system' AND p.pos > 1 AND f.tokens + p.tokens <= {BUDGET} AS retained
  FROM placed p JOIN placed f ON f.conv_id = p.conv_id AND f.pos = 1),
roomy AS (
  SELECT *, greatest(0, least({HISTORY}, {BUDGET} - tokens - CASE WHEN retained THEN system_tokens ELSE 0 END)) AS room FROM led),
backs AS (
  SELECT p.conv_id, p.pos, coalesce(min(b.pos), p.pos) AS back
  FROM roomy p LEFT JOIN placed b ON b.conv_id = p.conv_id AND b.pos < p.pos AND (b.pos > 1 OR NOT p.has_system)
       AND p.through_ - p.tokens - (b.through_ - b.tokens) <= p.room
  GROUP BY p.conv_id, p.pos),
ends AS (
  SELECT p.conv_id, p.pos, k.back, coalesce(max(e.pos), p.pos) AS last_
  FROM roomy p JOIN backs k ON k.conv_id = p.conv_id AND k.pos = p.pos
  JOIN placed b ON b.conv_id = p.conv_id AND b.pos = k.back
  LEFT JOIN placed e ON e.conv_id = p.conv_id AND e.pos >= p.pos
       AND e.through_ - (b.through_ - b.tokens) + CASE WHEN p.retained THEN p.system_tokens ELSE 0 END <= {BUDGET}
  GROUP BY p.conv_id, p.pos, k.back),
chain AS (
  SELECT conv_id, pos, back, last_ FROM ends WHERE pos = 1
  UNION ALL
  SELECT e.conv_id, e.pos, e.back, e.last_ FROM chain c JOIN ends e ON e.conv_id = c.conv_id AND e.pos = c.last_ + 1),
formatted AS (
  SELECT c.conv_id, sum(e.upto - b.upto + b.chars + CASE WHEN p.retained THEN p.system_chars ELSE 0 END)::BIGINT AS formatted_chars
  FROM chain c JOIN led p ON p.conv_id = c.conv_id AND p.pos = c.pos
  JOIN placed b ON b.conv_id = c.conv_id AND b.pos = c.back JOIN placed e ON e.conv_id = c.conv_id AND e.pos = c.last_
  GROUP BY c.conv_id),
said AS (
  SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY pos)) AS turns_sha256,
         coalesce(string_agg(text, '' ORDER BY pos) FILTER (WHERE role = 'assistant'), '') AS loss
  FROM placed GROUP BY conv_id)
SELECT said.conv_id, n_turns, turns_sha256, length(loss)::BIGINT AS loss_chars, sha256(loss) AS loss_sha256, formatted_chars
FROM said JOIN formatted ON formatted.conv_id = said.conv_id
"""
