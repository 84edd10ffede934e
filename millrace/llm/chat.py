"""Chat formatting from a declarative template (native: DataFrame functions only).

Every turn becomes three segments - header, escaped text, end mark - each with
a loss flag; a finite-state machine over the roles validates the order of turns.

Escaping: the escape character and the template's control strings inside a
text are replaced by two-character codes, so that an escaped text holds no
control string and every backslash in it starts a code. That makes splitting at
the end mark exact and the replacement reversible, code by code.

A conversation may hold a third of all rows, so rows are first gathered in
chunks of CHUNK turns; the machine maps each chunk to a function from start
state to end state, and those functions compose per conversation.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import let

CHUNK = 256


@dataclass(frozen=True)
class Template:
    """Headers and loss flags by role, the order of turns, and the codes of control strings."""

    header_start: str = "### "
    header_end: str = ": "
    end: str = "</turn>\n"
    #: role -> (title in the header, is its text under the loss mask)
    roles: dict = field(
        default_factory=lambda: {
            "system": ("System", False),
            "user": ("User", False),
            "assistant": ("Assistant", True),
            "tool": ("Tool", False),
        }
    )
    #: Title of any other role; the escaped role follows.
    other: str = "role="
    #: Escape codes; the backslash is coded first and decoded last.
    codes: tuple = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
    #: In roles also the colon, which ends a title.
    role_codes: tuple = ((":", "\\c"),)
    #: state -> roles that may come next; a role's name is the state after it.
    order: dict = field(
        default_factory=lambda: {
            "start": ("system", "user"),
            "system": ("user",),
            "user": ("assistant",),
            "assistant": ("user", "tool"),
            "tool": ("assistant", "tool"),
        }
    )
    final: tuple = ("assistant",)

    def escape(self, text: Column, codes: tuple | None = None) -> Column:
        for plain, code in codes or self.codes:
            text = F.replace(text, F.lit(plain), F.lit(code))
        return text

    def unescape(self, text: Column, codes: tuple | None = None) -> Column:
        for plain, code in reversed(codes or self.codes):
            text = F.replace(text, F.lit(code), F.lit(plain))
        return text

    def header(self, role: Column) -> Column:
        title = F.concat(F.lit(self.other), self.escape(role, self.codes + self.role_codes))
        for name, (shown, _) in self.roles.items():
            title = F.when(role == name, F.lit(shown)).otherwise(title)
        return F.concat(F.lit(self.header_start), title, F.lit(self.header_end))

    def role_of(self, title: Column) -> Column:
        role = self.unescape(F.substr(title, F.lit(len(self.other) + 1)), self.codes + self.role_codes)
        for name, (shown, _) in self.roles.items():
            role = F.when(title == shown, F.lit(name)).otherwise(role)
        return role

    def has_loss(self, role: Column) -> Column:
        return role.isin([r for r, (_, loss) in self.roles.items() if loss])

    @property
    def states(self) -> list[str]:
        return [*self.order, "invalid"]


def _ends(template: Template, turns: Column) -> Column:
    """Index of the end state of ``turns`` for every start state."""
    states = template.states
    bad = len(states) - 1
    roles = list(template.roles)
    width = len(roles) + 1
    steps = [
        states.index(r) if r in template.order.get(s, ()) else bad for s in states for r in ("", *roles)
    ]
    table = F.array(*[F.lit(x) for x in steps])
    names = F.array(*[F.lit(r) for r in roles])

    def fold(s: int) -> Column:
        return F.aggregate(
            turns,
            F.lit(s),
            lambda a, x: F.get(table, a * width + F.array_position(names, x["role"]).cast("int")),
        )

    return F.array(*[fold(s) for s in range(len(states))])


def format_conversations(rows: DataFrame, template: Template = Template()) -> DataFrame:
    """conv_id, n_turns, valid, segments (array of text and loss), one row per conversation.

    Turns stand by turn, then role, then text (null turns first, so ties and
    repeated rows have a fixed place and each is formatted). Null roles and
    texts count as empty. A null conv_id is a conversation of its own. Invalid
    orders are formatted too and only flagged. An empty table gives no rows;
    other columns are ignored.
    """
    t = rows.select(
        "conv_id",
        F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    chunks = (
        t.withColumn("chunk", F.floor(F.col("turn") / CHUNK))
        .groupBy("conv_id", "chunk")
        .agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
        .select(
            "conv_id",
            F.struct(
                "chunk",
                F.size("turns").alias("n"),
                _ends(template, F.col("turns")).alias("ends"),
                F.flatten(
                    F.transform(
                        "turns",
                        lambda x: F.array(
                            F.struct(template.header(x["role"]).alias("text"), F.lit(False).alias("loss")),
                            F.struct(
                                template.escape(x["text"]).alias("text"), template.has_loss(x["role"]).alias("loss")
                            ),
                            F.struct(F.lit(template.end).alias("text"), F.lit(False).alias("loss")),
                        ),
                    )
                ).alias("segments"),
            ).alias("part"),
        )
    )
    final = [template.states.index(s) for s in template.final]
    return (
        chunks.groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("part"), _by_chunk).alias("parts"))
        .select(
            "conv_id",
            F.aggregate("parts", F.lit(0), lambda a, p: a + p["n"]).cast("long").alias("n_turns"),
            F.aggregate("parts", F.lit(0), lambda a, p: F.get(p["ends"], a)).isin(final).alias("valid"),
            F.flatten(F.transform("parts", lambda p: p["segments"])).alias("segments"),
        )
    )


def _by_chunk(a: Column, b: Column) -> Column:
    """Order of chunks, null first; there is one part per chunk."""
    x, y = F.coalesce(a["chunk"], F.lit(-(2**62))), F.coalesce(b["chunk"], F.lit(-(2**62)))
    return F.when(x < y, -1).when(x > y, 1).otherwise(0)


def read_back(formatted: Column, template: Template = Template()) -> Column:
    """The turns (role, text) of a formatted conversation."""
    mark = "".join("\\n" if c == "\n" else "\\" + c if not c.isalnum() else c for c in template.end)
    parts = F.split(formatted, mark)
    start, gap = len(template.header_start), len(template.header_end)

    def turn(p: Column) -> Column:
        def parse(head: Column) -> Column:
            return F.struct(
                template.role_of(F.substr(head, F.lit(start + 1))).alias("role"),
                template.unescape(F.substr(p, F.length(head) + gap + 1)).alias("text"),
            )

        return let(F.substring_index(p, template.header_end, 1), parse)

    return F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), turn)


def digest(done: DataFrame, template: Template = Template()) -> DataFrame:
    """What the formatted output says, read back from it."""
    out = done.withColumn("formatted", F.array_join(F.col("segments.text"), "")).withColumn(
        "loss",
        template.unescape(F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: s["text"]), "")),
    )
    said = F.array_join(
        F.transform(read_back(F.col("formatted"), template), lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))),
        "",
    )
    return out.select(
        "conv_id",
        "n_turns",
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
    )


def probe(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose two texts hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    turns = [
        F.struct(
            F.lit(-7).cast("long").alias("conv_id"), F.lit(i).cast("long").alias("turn"),
            F.lit(role).alias("role"), F.lit(text).alias("text"),
        )
        for i, role in enumerate(("user", "assistant"))
    ]
    return spark.range(1).select(F.inline(F.array(*turns)))


ORACLE = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, i, r, '\### Assistant: </turn> ok' FROM (VALUES (0, 'user'), (1, 'assistant')) v(i, r)
), s AS (
  SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS before,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
    count(*) OVER (PARTITION BY conv_id) AS n,
    length(replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\e')) AS escaped,
    CASE WHEN role IN ('system', 'user', 'assistant', 'tool') THEN length(role)
         ELSE 5 + length(replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\e'), ':', '\c')) END AS title
  FROM t
), v AS (
  SELECT *, CASE WHEN k = 1 THEN role IN ('system', 'user') WHEN before = 'system' THEN role = 'user'
      WHEN before = 'user' THEN role = 'assistant' WHEN before = 'assistant' THEN role IN ('user', 'tool')
      WHEN before = 'tool' THEN role IN ('assistant', 'tool') ELSE false END AND (k < n OR role = 'assistant') AS fine
  FROM s
)
SELECT conv_id, count(*)::BIGINT AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY k)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY k) FILTER (role = 'assistant'), '')) AS loss_sha256,
  sum(4 + title + 2 + escaped + 8)::BIGINT AS formatted_chars, bool_and(fine) AS valid
FROM v GROUP BY conv_id
"""
