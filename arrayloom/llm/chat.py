"""Chat formatting by a finite-state machine over roles (native).

A declarative template names the open and close control strings of each role,
whether its text is trained on, and the allowed next states. Control strings
inside texts are escaped by one backslash after their first character, and
strings that look escaped get one more, so unescaping restores every text.

One row a conversation, as the result is one string that is hashed whole; a
conversation must fit a row. Turns are ordered by (turn, role, text).

Defined cases: null text: empty; null role: the empty role, formatted by the
generic markers and never valid; repeated turns stay, each once a row; a null
conversation id is a conversation of its own; an empty table gives no rows;
other columns are ignored. A conversation that breaks the turn order is
formatted all the same with ``valid`` false and ``bad_turn`` its first wrong
position.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from arrayloom.llm.common import let


@dataclass(frozen=True)
class Template:
    """role -> (open, close, trained); state -> {role: next state}."""

    begin: str = "<s>"
    roles: dict = field(
        default_factory=lambda: {
            "system": ("[SYS]", "[/SYS]", False),
            "user": ("[INST]", "[/INST]", False),
            "assistant": ("<|answer|>", "</s>", True),
        }
    )
    #: Any other role: its name stands between the first two strings.
    other: tuple = ("<|role|>", "<|says|>", "<|end|>")
    moves: dict = field(
        default_factory=lambda: {
            "start": {"system": "told", "user": "asked"},
            "told": {"user": "asked"},
            "asked": {"assistant": "answered"},
            "answered": {"user": "asked"},
        }
    )
    accept: tuple = ("answered",)

    def controls(self) -> list[str]:
        found = [self.begin, *self.other]
        for opened, closed, _ in self.roles.values():
            found += [opened, closed]
        return list(dict.fromkeys(found))


def _quote(s: str) -> str:
    return "".join(f"\\{c}" if c in "\\^$.|?*+()[]{}<>/" else c for c in s)


def _pattern(t: Template, escapes: str) -> str:
    heads = sorted({c[0] for c in t.controls()})
    for c in t.controls():
        if any(h in c[1:] for h in heads) or "\\" in c:
            raise ValueError(f"control string {c!r} holds a backslash or the first character of one")
    tails = sorted({c[1:] for c in t.controls()}, key=lambda x: (-len(x), x))
    by_head = "|".join(f"{_quote(h)}(?={escapes}(?:{'|'.join(_quote(x) for x in tails if h + x in t.controls())}))" for h in heads)
    return f"({by_head})"


def escape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, _pattern(t, r"\\*"), r"$1\\")


def unescape(text: Column, t: Template) -> Column:
    return F.regexp_replace(text, _pattern(t, r"\\+") + r"\\", "$1")


def format_conversations(turns: DataFrame, template: Template | None = None) -> DataFrame:
    """conv_id, formatted, segments (role, piece, loss), loss_spans, valid, bad_turn.

    Loss spans are (start, length) in code points of ``formatted`` and cover
    the trained texts alone, not their markers.
    """
    t = template or Template()
    turn = F.struct(
        F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    grouped = turns.select("conv_id", turn.alias("x")).groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("turns"))

    def segments(x: Column) -> Column:
        opened = F.concat(F.lit(t.other[0]), escape(x.role, t), F.lit(t.other[1]))
        closed, trained = F.lit(t.other[2]), F.lit(False)
        for role, (a, b, loss) in t.roles.items():
            opened = F.when(x.role == role, F.lit(a)).otherwise(opened)
            closed = F.when(x.role == role, F.lit(b)).otherwise(closed)
            trained = F.when(x.role == role, F.lit(loss)).otherwise(trained)
        piece = lambda s, loss: F.struct(x.role.alias("role"), s.alias("piece"), loss.alias("loss"))
        return F.array(piece(opened, F.lit(False)), piece(escape(x.text, t), trained), piece(closed, F.lit(False)))

    def step(state: Column, x: Column) -> Column:
        to = F.lit("wrong")
        for source, moves in t.moves.items():
            for role, target in moves.items():
                to = F.when((state.state == source) & (x.role == role), F.lit(target)).otherwise(to)
        n = state.n + (state.state != "wrong").cast("long")
        return F.struct(to.alias("state"), F.when(state.state == "wrong", state.n).otherwise(n).alias("n"))

    begin = F.array(F.struct(F.lit("").alias("role"), F.lit(t.begin).alias("piece"), F.lit(False).alias("loss")))
    start = F.struct(F.lit("start").alias("state"), F.lit(0).cast("long").alias("n"))
    made = grouped.select(
        "conv_id",
        "turns",
        F.concat(begin, F.flatten(F.transform("turns", segments))).alias("segments"),
        F.aggregate("turns", start, step).alias("end"),
    )
    span0 = F.struct(
        F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans")
    )

    def spans(state: Column, s: Column) -> Column:
        n = F.length(s.piece).cast("long")
        mine = F.array(F.struct(state.at.alias("start"), n.alias("length")))
        return F.struct(
            (state.at + n).alias("at"), F.when(s.loss, F.concat(state.spans, mine)).otherwise(state.spans).alias("spans")
        )

    ok = F.col("end.state").isin(*t.accept)
    return made.select(
        "conv_id",
        F.array_join(F.transform("segments", lambda s: s.piece), "").alias("formatted"),
        "segments",
        F.aggregate("segments", span0, spans).spans.alias("loss_spans"),
        ok.alias("valid"),
        F.when(~ok & (F.col("end.state") == "wrong"), F.col("end.n") - 1).alias("bad_turn"),
    )


def read_back(formatted: Column, template: Template | None = None) -> Column:
    """array<struct<role, text>> parsed from a formatted conversation alone."""
    t = template or Template()
    closes = [b for _, b, _ in t.roles.values()] + [t.other[2]]
    cut = f"(?<={'|'.join(_quote(c) for c in dict.fromkeys(closes))})"
    body = F.substring(formatted, len(t.begin) + 1, 2**31 - 1)
    turns = F.array_remove(F.split(body, cut), "")

    def parse(s: Column) -> Column:
        def inner(opened: str, closed: str) -> Column:
            return F.substring(s, F.lit(len(opened) + 1), F.length(s) - len(opened) - len(closed))

        whole = inner(t.other[0], t.other[2])
        role = unescape(F.substring_index(whole, t.other[1], 1), t)
        n = F.length(F.substring_index(whole, t.other[1], 1)) + len(t.other[1])
        text = F.substring(whole, n + 1, F.length(whole) - n)
        for name, (a, b, _) in t.roles.items():
            mine = F.startswith(s, F.lit(a))
            role = F.when(mine, F.lit(name)).otherwise(role)
            text = F.when(mine, inner(a, b)).otherwise(text)
        return F.struct(role.alias("role"), unescape(text, t).alias("text"))

    return F.transform(turns, parse)


def digest(formatted: DataFrame, template: Template | None = None) -> DataFrame:
    """Digest columns, all read back from ``formatted`` and ``loss_spans``."""
    t = template or Template()
    text = let(
        F.col("formatted"),
        lambda s: F.array_join(
            F.transform(
                "loss_spans",
                lambda p: unescape(F.substring(s, (p.start + 1).cast("int"), p["length"].cast("int")), t),
            ),
            "",
        ),
    )
    made = formatted.select(
        "conv_id", "formatted", "valid", "bad_turn", read_back(F.col("formatted"), t).alias("turns"), text.alias("loss")
    )
    lines = F.array_join(F.transform("turns", lambda x: F.concat(x.role, F.lit("\n"), x.text, F.lit("\n"))), "")
    return made.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(lines, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "valid",
        "bad_turn",
    )
