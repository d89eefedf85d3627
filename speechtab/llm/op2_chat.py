"""Chat formatting from a declarative template, with a finite-state machine over the roles.

The template gives the control strings, the roles whose text is under the loss mask and the transitions between
states. Each turn becomes three segments (header, text, end), each with a loss flag; a conversation's formatted string
is their concatenation. Control strings inside roles and texts are escaped reversibly: a backslash stands before every
backslash and inside every ``<|`` of the source.

Turns are gathered in two levels: runs of 64 turn numbers first, where the machine is folded into one map from state to
state, then the runs of a conversation, whose maps compose. No task sorts the single turns of a long conversation.

Null roles and texts count as empty; null turn numbers come first; rows of equal turn are ordered by role, then text;
repeated rows are turns of their own. Unknown roles and wrong orders make ``valid`` false, but are still formatted.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    start: str = "<|im_start|>"
    end: str = "<|im_end|>"
    loss_roles: tuple[str, ...] = ("assistant",)
    #: (state, role) -> state; everything else goes to the sink ``bad``.
    transitions: dict[tuple[str, str], str] = field(
        default_factory=lambda: {
            ("begin", "system"): "asked_for",
            ("begin", "user"): "asked",
            ("asked_for", "user"): "asked",
            ("asked", "assistant"): "answered",
            ("answered", "user"): "asked",
        }
    )
    accept: tuple[str, ...] = ("answered",)

    @property
    def states(self) -> list[str]:
        inner = {s for (a, _), b in self.transitions.items() for s in (a, b)} | {*self.accept}
        return ["begin", *sorted(inner - {"begin", "bad"}), "bad"]

    def step(self, role: Column, state: Column) -> Column:
        """The number of the state after ``role`` in the state of number ``state``."""
        names = self.states
        rows = F.lit(len(names) - 1)
        for (a, r), b in self.transitions.items():
            rows = F.when((state == names.index(a)) & (role == r), names.index(b)).otherwise(rows)
        return rows


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\\n"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, template: Template | None = None, run: int = 64) -> DataFrame:
    """conv_id, formatted, segments (array of text and loss), n_rows, valid from rows of (conv_id, turn, role, text)."""
    t = template or Template()
    n_states = len(t.states)
    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    runs = (
        turns.select("conv_id", "turn", empty("role").alias("role"), empty("text").alias("text"))
        .groupBy("conv_id", F.floor(F.col("turn") / run).alias("run"))
        .agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    )

    def segment(text: Column, loss: Column) -> Column:
        return F.struct(text.alias("text"), loss.alias("loss"))

    def segments(x: Column) -> Column:
        off = F.lit(False)
        return F.array(
            segment(F.concat(F.lit(t.start), escape_role(x["role"]), F.lit("\n")), off),
            segment(escape(x["text"]), x["role"].isin(*t.loss_roles)),
            segment(F.lit(t.end + "\n"), off),
        )

    runs = runs.select(
        "conv_id",
        F.struct(
            "run",
            F.size("turns").alias("n"),
            F.flatten(F.transform("turns", segments)).alias("segments"),
            F.aggregate(
                "turns",
                F.array(*[F.lit(i) for i in range(n_states)]),
                lambda acc, x: F.transform(acc, lambda s: t.step(x["role"], s)),
            ).alias("moves"),
        ).alias("x"),
    )
    convs = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list("x")).alias("runs"))
    last = F.aggregate("runs", F.lit(0), lambda s, r: F.get(r["moves"], s))
    accepted = [F.lit(t.states.index(a)) for a in t.accept]
    return convs.select(
        "conv_id",
        F.flatten(F.col("runs.segments")).alias("segments"),
        F.aggregate("runs", F.lit(0), lambda a, r: a + r["n"]).alias("n_rows"),
        reduce(lambda a, b: a | b, [last == a for a in accepted]).alias("valid"),
    ).withColumn("formatted", F.array_join("segments.text", ""))


def read_turns(formatted: Column, template: Template | None = None) -> Column:
    """Array of (role, text) parsed from a formatted string, unescaped."""
    t = template or Template()
    tail = len(t.end) + 1
    parts = F.split(formatted, r"\Q" + t.start + r"\E", -1)
    parts = F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0)))

    def turn(p: Column) -> Column:
        role = F.regexp_extract(p, r"(?s)\A([^\\\n]*+(?:\\.[^\\\n]*+)*+)\n", 1)
        text = F.substring(p, F.length(role) + 2, F.length(p) - F.length(role) - 1 - tail)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(parts, turn)


def digests(out: DataFrame, template: Template | None = None) -> DataFrame:
    """Reads the formatted strings and segments back and digests them, one row per conversation."""
    turns = F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n")))
    under = F.filter("segments", lambda s: s["loss"])
    return (
        out.withColumn("turns", read_turns(F.col("formatted"), template))
        .withColumn("loss", F.array_join(F.transform(under, lambda s: unescape(s["text"])), ""))
        .select(
            "conv_id",
            F.size("turns").cast("long").alias("n_turns"),
            F.sha2(F.array_join(turns, "").cast("binary"), 256).alias("turns_sha256"),
            F.length("loss").cast("long").alias("loss_chars"),
            F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
            F.length("formatted").cast("long").alias("formatted_chars"),
            "valid",
        )
    )
