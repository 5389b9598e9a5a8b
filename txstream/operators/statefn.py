"""State functions: default, update and invariant of a keyed state, as Columns and as Python.

An additive function, ``v + amount`` within bounds, runs as parallel prefix sums; any other runs as a fold in order. The
sums are of whole units of 10**-scale, so that their order doesn't matter: every way to run a ledger gives the same votes
and values, bit for bit.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


class UnknownCommand(ValueError):
    """A command names a method that the state doesn't offer."""


@dataclass(frozen=True)
class StateFunction:
    """``apply(v, elem)`` and ``invariant(v)`` take and give Columns; the ``py_`` forms take and give Python values."""

    default: Any
    value_type: str
    apply: Callable[[Column, Column], Column]
    invariant: Callable[[Column], Column]
    py_apply: Callable[[Any, Any], Any]
    py_invariant: Callable[[Any], bool]
    amount: Callable[[Column], Column] | None = None  # the summand, if additive
    low: float | None = None
    high: float | None = None
    low_open: bool = False
    free: bool = False  # no invariant: whether a transaction commits doesn't depend on it
    #: method -> (Column form, Python form); the last argument is the current value.
    commands: dict[str, tuple[Callable[..., Column], Callable[..., Any]]] = field(default_factory=dict)
    #: Decimal places of an additive state's amounts and bounds.
    scale: int = 0

    @property
    def additive(self) -> bool:
        return self.amount is not None

    def default_column(self) -> Column:
        return F.lit(self.default).cast(self.value_type) if not isinstance(self.default, list) else F.array().cast(self.value_type)

    def beyond(self, low: Column, high: Column) -> Column:
        """Whether a value of ``low`` is below the bounds, or one of ``high`` above."""
        found = F.lit(False)
        if self.low is not None:
            found |= (low <= self.low) if self.low_open else (low < self.low)
        if self.high is not None:
            found |= high > self.high
        return found

    def within(self, low: Column, high: Column) -> Column:
        """Whether all values from ``low`` to ``high`` satisfy the bounds."""
        found = F.lit(True)
        if self.low is not None:
            found &= (low > self.low) if self.low_open else (low >= self.low)
        if self.high is not None:
            found &= high <= self.high
        return found

    def units(self, amount: Column) -> Column:
        """An amount as whole units; one with more decimal places than the state has is an error."""
        many = amount.cast("double") * float(10**self.scale)
        whole = F.round(many)
        off = F.abs(many - whole) > F.greatest(F.lit(1e-6), F.abs(many) * 1e-12)
        wrong = F.raise_error(F.concat(F.lit(f"an amount has more than {self.scale} decimal places: "), amount.cast("string")))
        return F.when(off, wrong.cast("bigint")).otherwise(whole.cast("bigint"))

    def in_units(self) -> "StateFunction":
        """The same function on whole units."""
        unit = lambda x: None if x is None else round(x * 10**self.scale)
        low, high, low_open = unit(self.low), unit(self.high), self.low_open

        def ok(v: int) -> bool:
            return (low is None or v > low or v == low and not low_open) and (high is None or v <= high)

        fn = replace(
            self, default=unit(self.default), value_type="bigint", apply=lambda v, e: v + e, py_apply=lambda v, e: v + e, py_invariant=ok, amount=lambda e: e,
            low=low, high=high, scale=0, commands={},
        )
        object.__setattr__(fn, "invariant", lambda v: fn.within(v, v))
        return fn

    def command(self, method: str) -> tuple[Callable[..., Column], Callable[..., Any]]:
        if method not in self.commands:
            raise UnknownCommand(f"{method} is not a command of this state")
        return self.commands[method]


def additive(default: float, amount: Callable[[Column], Column] = lambda e: e, low: float | None = None, high: float | None = None, low_open: bool = False, commands: dict | None = None, scale: int = 4) -> StateFunction:
    """``v + amount(elem)``; values must stay within low (open if ``low_open``) and high.

    Amounts have up to ``scale`` decimal places; values up to 9.2e18 / 10**scale.
    """

    def ok(v: float) -> bool:
        return (low is None or v > low or v == low and not low_open) and (high is None or v <= high)

    fn = StateFunction(
        float(default), "double", lambda v, e: v + amount(e), lambda v: F.lit(True), lambda v, e: v + e, ok, amount,
        low, high, low_open, False, commands or {}, scale,
    )
    object.__setattr__(fn, "invariant", lambda v: fn.within(v, v))
    return fn


#: Deposits and withdrawals of an account, by amount; the current value comes last.
ACCOUNT_COMMANDS = {
    "deposit": (lambda a, v: v + a, lambda a, v: v + a),
    "withdrawal": (lambda a, v: v - a, lambda a, v: v - a),
}


def appending(item_type: str) -> StateFunction:
    """A list that grows by each element."""
    return StateFunction([], f"array<{item_type}>", lambda v, e: F.array_append(v, e), lambda v: F.lit(True), lambda v, e: [*v, e], lambda v: True, free=True)


def overwriting(value_type: str, default: Any = None) -> StateFunction:
    """The last element written."""
    return StateFunction(default, value_type, lambda v, e: e, lambda v: F.lit(True), lambda v, e: e, lambda v: True, free=True)
