"""Settings of a transactional graph."""

from __future__ import annotations

from dataclasses import dataclass, replace
from enum import IntEnum


class Isolation(IntEnum):
    """What a graph must guarantee at least; execution in transaction order satisfies each of them."""

    PL0 = 0
    PL1 = 1
    PL2 = 2
    PL3 = 3
    PL4 = 4


OPTIMISTIC, PESSIMISTIC = "OPTIMISTIC", "PESSIMISTIC"


@dataclass(frozen=True)
class TxConfig:
    #: The weakest state that queries may read (``store.as_of``).
    isolation: Isolation = Isolation.PL3
    #: Optimistic: in order up to ``serial_limit``, in rounds beyond. Pessimistic: in the order of keys' lock queues.
    strategy: str = OPTIMISTIC
    #: Whether streaming graphs log what they close.
    durable: bool = False
    #: Whether results that ask for a replay are given on, as a baseline without transactions would.
    baseline: bool = False
    #: Versions of a key that a streaming graph's bases keep (None: the last).
    max_versions: int | None = None
    #: Tasks that number and admit transactions (None or 0: as Spark deals them); numbering is total with any of them.
    parallelism: int | None = None
    #: Operations up to which one task runs a ledger in order; larger ones run in rounds.
    serial_limit: int = 1_000_000
    #: Open operations that rounds leave to one task.
    rest_limit: int = 100_000

    def __post_init__(self) -> None:
        if self.strategy not in (OPTIMISTIC, PESSIMISTIC):
            raise ValueError(f"no such strategy: {self.strategy}")
        if self.isolation == Isolation.PL0:  # the weakest level has no locking form
            object.__setattr__(self, "strategy", OPTIMISTIC)

    def with_(self, **changes) -> "TxConfig":
        return replace(self, **changes)

    @property
    def open_parallelism(self) -> int | None:
        return self.parallelism if self.parallelism and self.parallelism > 0 else None


#: The isolation levels and strategies of a sweep.
SWEEP = [(OPTIMISTIC, level) for level in (Isolation.PL2, Isolation.PL3, Isolation.PL4)] + [(PESSIMISTIC, level) for level in (Isolation.PL3, Isolation.PL4)]
