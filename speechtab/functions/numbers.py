"""Spoken numbers: idiom guard, parser and conversion, as folds over the words of a text.

Two modes: ``compat`` gives the published behaviour, in which a unit word overwrites what stands before it, hundreds
included; ``additive`` adds a unit that follows a hundred.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechtab import vocab
from speechtab.functions.text import SPACES, words


def _lookup(values: dict[str, int], word: Column) -> Column:
    pairs = [F.lit(x) for kv in values.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), word).cast("long")


def is_idiomatic(text: Column) -> Column:
    return F.rlike(text, F.lit("|".join(i.replace(" ", SPACES) for i in vocab.IDIOMS)))


def _state(total: Column, current: Column, on: Column, hundred: Column, out: Column, done: Column | None = None) -> Column:
    return F.struct(
        total.cast("long").alias("total"), current.cast("long").alias("current"), on.alias("on"), hundred.alias("hundred"),
        out.alias("out"), (F.lit(0) if done is None else done).cast("long").alias("done"),
    )


def _start() -> Column:
    zero = F.lit(0)
    return _state(zero, zero, F.lit(False), F.lit(False), F.array().cast("array<string>"))


def _step(acc: Column, word: Column, mode: str) -> Column:
    """The number part of a fold: the state after a number word, which goes on with the running number or starts one."""
    unit, times = _lookup(vocab.UNITS, word), _lookup(vocab.MULTIPLIERS, word)
    yes, no = F.lit(True), F.lit(False)
    total, current = F.when(acc["on"], acc["total"]).otherwise(0), F.when(acc["on"], acc["current"]).otherwise(0)
    new = F.when(acc["on"] & acc["hundred"], current + unit).otherwise(unit) if mode == "additive" else unit
    factor = F.when(current == 0, 1).otherwise(current)
    done = acc["done"] + 1
    return (
        F.when(unit.isNotNull(), _state(total, new, yes, no, acc["out"], done))
        .when(times >= 1000, _state(total + factor * times, F.lit(0), yes, no, acc["out"], done))
        .otherwise(_state(total, factor * times, yes, yes, acc["out"], done))
    )


def _is_number(word: Column) -> Column:
    return word.isin(*vocab.UNITS, *vocab.MULTIPLIERS)


def parse_number(tokens: Column, mode: str = "compat") -> Column:
    """Struct of value and consumed: the number that ``tokens`` start with; (null, 0) if they start with none."""
    end = F.size(F.filter(F.transform(tokens, lambda w, i: F.when(~_is_number(w), i)), lambda i: i.isNotNull()))
    lead = F.when(end == 0, F.size(tokens)).otherwise(
        F.array_min(F.filter(F.transform(tokens, lambda w, i: F.when(~_is_number(w), i)), lambda i: i.isNotNull()))
    )
    got = F.aggregate(F.slice(tokens, F.lit(1), lead), _start(), lambda acc, w: _step(acc, w, mode))
    return F.struct(F.when(lead > 0, got["total"] + got["current"]).alias("value"), lead.alias("consumed"))


def convert_numbers(text: Column | str, mode: str = "compat") -> Column:
    """Every maximal run of number words as one integer, tokens joined by one space; texts with an idiom stay as they are."""
    text = F.col(text) if isinstance(text, str) else text

    def close(acc: Column) -> Column:
        number = F.array((acc["total"] + acc["current"]).cast("string"))
        return F.when(acc["on"], F.concat(acc["out"], number)).otherwise(acc["out"])

    def step(acc: Column, word: Column) -> Column:
        other = _state(F.lit(0), F.lit(0), F.lit(False), F.lit(False), F.concat(close(acc), F.array(word)), acc["done"])
        return F.when(_is_number(word), _step(acc, word, mode)).otherwise(other)

    folded = F.array_join(F.aggregate(words(text), _start(), step, close), " ")
    return F.when(is_idiomatic(text), text).otherwise(folded)
