"""Operator 2: chat formatting.

A declarative template names, for each role, the marks around a turn and whether
its text is trained on, and which role may follow which. A finite-state machine
over the roles validates the order of turns; the turns become text segments with
a loss flag each. Control strings inside texts are escaped: a backslash goes
behind their first character (behind it and any backslashes that already stand
there), so a formatted text holds control strings only as marks, and taking one
backslash away gives back the text.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from semdex.llm._common import table


@dataclass(frozen=True)
class ChatTemplate:
    """marks: role -> (before, after); other: marks of any other role, whose name
    stands between the first two; follows: state -> roles that may come next."""

    marks: dict = field(default_factory=lambda: {
        "system": ("<<SYS>>", "<</SYS>>"),
        "user": ("[INST]", "[/INST]"),
        "assistant": ("<s>", "</s>"),
    })
    other: tuple = ("[ROLE]", "[/ROLE]", "[END]")
    loss_roles: tuple = ("assistant",)
    follows: dict = field(default_factory=lambda: {
        "start": ("system", "user"),
        "system": ("user",),
        "user": ("assistant",),
        "assistant": ("user",),
    })
    final: tuple = ("assistant",)

    @property
    def controls(self) -> list[str]:
        return [m for pair in self.marks.values() for m in pair] + list(self.other)

    @property
    def _inside(self) -> tuple[str, str]:
        """Pattern of a control string's first character, and of its rest."""
        heads = "".join(sorted({re.escape(c[0]) for c in self.controls}))
        rests = sorted({c[1:] for c in self.controls}, key=lambda r: (-len(r), r))
        return f"([{heads}])", "(" + "|".join(map(re.escape, rests)) + ")"

    @property
    def escape_pattern(self) -> str:
        head, rest = self._inside
        return rf"{head}(\\*){rest}"

    @property
    def unescape_pattern(self) -> str:
        head, rest = self._inside
        return rf"{head}\\(\\*){rest}"

    @property
    def turn_pattern(self) -> str:
        """Groups: 1 the opening mark, 2 another role's name, 3 the text."""
        opens = "|".join(re.escape(b) for b, _ in self.marks.values())
        closes = "|".join(re.escape(c) for c in [*(a for _, a in self.marks.values()), self.other[2]])
        named = rf"{re.escape(self.other[0])}([\s\S]*?){re.escape(self.other[1])}"
        return rf"({opens}|{named})([\s\S]*?)(?:{closes})"

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.escape_pattern, r"$1\\$2$3")

    def unescape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.unescape_pattern, "$1$2$3")


def _map(pairs) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs for x in kv])


def format_chats(turns: DataFrame, template: ChatTemplate = ChatTemplate(), conv: str = "conv_id",
                 turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """One row per conversation: conv_id, segments, formatted, valid, bad_turn.

    segments is array<struct<text, loss>>; formatted is their texts joined.
    Rows are taken by turn, nulls first; rows that repeat a turn by role, then
    text. Null text or role counts as empty; an empty or unknown role is written
    with its name and never trained on. A null conv_id is a conversation of its
    own. valid says whether the roles pass the machine, bad_turn at which
    position (from 0) they first fail, or their number if the last role may not
    be last; invalid conversations are formatted all the same. Other columns are
    ignored. A conversation is one formatted text, hence one row in one task.
    """
    row = F.struct(F.col(f"`{turn}`").alias("turn"), F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
                   F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    chats = turns.groupBy(F.col(f"`{conv}`").alias("conv_id")).agg(F.sort_array(F.collect_list(row)).alias("turns"))

    before = _map((r, m[0]) for r, m in template.marks.items())
    after = _map((r, m[1]) for r, m in template.marks.items())
    head, mid, tail = template.other
    loss = F.array(*[F.lit(r) for r in template.loss_roles])

    def segment(value: Column, flag: Column) -> Column:
        return F.struct(value.alias("text"), flag.alias("loss"))

    def written(t: Column) -> Column:
        opening = F.coalesce(before[t["role"]], F.concat(F.lit(head), template.escape(t["role"]), F.lit(mid)))
        return F.array(segment(opening, F.lit(False)),
                       segment(template.escape(t["text"]), F.array_contains(loss, t["role"])),
                       segment(F.coalesce(after[t["role"]], F.lit(tail)), F.lit(False)))

    moves = _map((f"{state}>{nxt}", nxt) for state, allowed in template.follows.items() for nxt in allowed)
    start = F.struct(F.lit("start").alias("state"), F.lit(0).alias("at"), F.lit(-1).alias("bad"))

    def move(s: Column, t: Column) -> Column:
        to = moves[F.concat(s["state"], F.lit(">"), t["role"])]
        return F.struct(F.coalesce(to, F.lit("failed")).alias("state"), (s["at"] + 1).alias("at"),
                        F.when((s["bad"] < 0) & to.isNull(), s["at"]).otherwise(s["bad"]).alias("bad"))

    ended = (F.when(F.col("m.bad") >= 0, F.col("m.bad"))
             .when(~F.col("m.state").isin(*template.final), F.col("m.at")))
    return (chats.select("conv_id", F.flatten(F.transform("turns", written)).alias("segments"),
                         F.aggregate("turns", start, move).alias("m"))
            .select("conv_id", "segments", F.array_join("segments.text", "").alias("formatted"),
                    ended.isNull().alias("valid"), ended.alias("bad_turn")))


def read_chats(chats: DataFrame, template: ChatTemplate = ChatTemplate()) -> DataFrame:
    """Read formatted texts back: adds turns (array<struct<role, text>>) and loss_text."""
    role_of = _map((m[0], r) for r, m in template.marks.items())
    found = lambda group: F.regexp_extract_all("formatted", F.lit(template.turn_pattern), F.lit(group))
    turns = F.transform(
        F.arrays_zip(found(1).alias("o"), found(2).alias("r"), found(3).alias("x")),
        lambda z: F.struct(F.coalesce(role_of[z["o"]], template.unescape(z["r"])).alias("role"),
                           template.unescape(z["x"]).alias("text")))
    lost = F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: template.unescape(s["text"]))
    return chats.withColumn("turns", turns).withColumn("loss_text", F.array_join(lost, ""))


SAID = "</s>[INST] ok [/INST]"


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-1, 0, "user", SAID), (-1, 1, "assistant", SAID)],
                                  "conv_id long, turn long, role string, text string")
    chats = read_chats(format_chats(turns.unionByName(probe)))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return chats.select("conv_id", F.size("turns").cast("long").alias("n_turns"),
                        F.sha2(digest, 256).alias("turns_sha256"),
                        F.length("loss_text").cast("long").alias("loss_chars"),
                        F.sha2("loss_text", 256).alias("loss_sha256"),
                        F.length("formatted").cast("long").alias("formatted_chars"), "valid")


def _op2_sql() -> str:
    t = ChatTemplate()
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    cases = " ".join(f"WHEN {quote(r)} THEN {len(a) + len(b)}" for r, (a, b) in t.marks.items())
    named = sum(map(len, t.other))
    escaped = lambda c: f"length(regexp_replace({c}, {quote(t.escape_pattern)}, {quote(chr(92) + '1' + chr(92) * 2 + chr(92) + '2' + chr(92) + '3')}, 'g'))"
    moves = ", ".join(quote(f"{s}>{n}") for s, allowed in t.follows.items() for n in allowed)
    final = ", ".join(map(quote, t.final))
    loss = ", ".join(map(quote, t.loss_roles))
    return f"""
WITH raw AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', {quote(SAID)}
  UNION ALL SELECT -1, 1, 'assistant', {quote(SAID)}),
t AS (
  SELECT *, lag(role, 1, 'start') OVER w AS prev, lead(role) OVER w IS NULL AS last FROM raw
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role IN ({loss})), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role IN ({loss})), '')) AS loss_sha256,
       CAST(sum({escaped('text')} + CASE role {cases} ELSE {named} + {escaped('role')} END) AS BIGINT) AS formatted_chars,
       bool_and(prev || '>' || role IN ({moves})) AND bool_or(last AND role IN ({final})) AS valid
FROM t GROUP BY conv_id
"""


OP2_SQL = _op2_sql()
