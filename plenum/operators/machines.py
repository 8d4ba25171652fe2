"""State machines over keyed events: one definition for the batch walk and for the stream.

A machine's state is a tuple; `step` takes it and an event to the next one and may give rows. In batch, each key's
events come as sorted batches, so that no key has to fit in memory. As a stream, the state is kept by Spark between
micro-batches (`plenum.streaming.machines`). Times are microseconds.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from plenum.operators.lifecycle import TRANSITIONS

SECOND = 1_000_000
#: Seconds that an add-on session and its transit token live.
SESSION, TRANSIT = 3_600, 120
#: The statuses that some event leads to, by event.
REACHES = {e: {to for (_, e2), to in TRANSITIONS.items() if e2 == e} for _, e in TRANSITIONS}


class Machine:
    """`state` and `out`: schemas as text. `columns`: of an event, in the order of `step`'s row; the last is its time."""

    state: str
    out: str
    columns: tuple[str, ...]

    def start(self) -> tuple:
        raise NotImplementedError

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        raise NotImplementedError

    def last(self, state: tuple) -> list[tuple]:
        """Rows after a key's events: all of them in batch, those of a micro-batch in a stream."""
        return []

    def due(self, state: tuple) -> int | None:
        """When something happens if no event comes."""
        return None

    def expire(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        return state, []


class Recording(Machine):
    """A recording's status. An event that doesn't fit changes nothing and is counted, unless it repeats what has been reached."""

    state = "status string, illegal int, n long"
    out = "status string, illegal int, n long"

    def __init__(self, event: str, at: str):
        self.columns = (event, at)

    def start(self) -> tuple:
        return "initiated", 0, 0

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        status, illegal, n = state
        to = TRANSITIONS.get((status, row[0]))
        odd = to is None and status not in REACHES.get(row[0], ())
        return (to or status, illegal + odd, n + 1), []

    def last(self, state: tuple) -> list[tuple]:
        return [state]


class Session(Machine):
    """An add-on's session and its single-use transit token, which are made together.

    init makes both. consume takes the token once; a second time, while it is remembered, is a replay and evicts the
    session. authenticate needs a pending session whose token has been taken, and evicts any other. poll tells the
    state; an authenticated session is read once. A token lives TRANSIT seconds, from its use on as long as a session.
    """

    state = "token string, token_until long, session string, session_until long"
    out = "id long, outcome string"

    def __init__(self, kind: str, order: str, at: str, life: int = SESSION, transit: int = TRANSIT):
        self.columns, self.life, self.transit = (kind, order, at), life * SECOND, transit * SECOND

    def start(self) -> tuple:
        return "none", 0, "none", 0

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (kind, order, now), (token, token_until, session, session_until) = row, state
        token = token if token_until > now else "none"
        session = session if session_until > now else "none"
        outcome = None
        if kind == "init":
            token, token_until, session, session_until, outcome = "pending", now + self.transit, "pending", now + self.life, "made"
        elif kind == "consume":
            outcome = {"none": "unknown", "pending": "consumed", "consumed": "replay"}[token]
            if token == "pending":
                token, token_until = "consumed", now + self.life
            elif token == "consumed":
                session = "none"
        elif kind == "authenticate":
            fits = session == "pending" and token == "consumed"
            outcome = "not_found" if session == "none" else "authenticated" if fits else "suspicious"
            session = "authenticated" if fits else "none"
        elif kind == "poll":
            outcome = "not_found" if session == "none" else session
            session = "none" if session == "authenticated" else session
        return (token, token_until, session, session_until), [(order, outcome)] if outcome else []


class Sliding(Machine):
    """A call passes if fewer than `most` accepted calls lie in the `window` before it. The state is the times of those, trimmed by event time."""

    state = "held array<long>"
    out = "id long, accepted boolean"

    def __init__(self, order: str, at: str, most: int, window: int):
        self.columns, self.most, self.window = (order, at), most, window

    def start(self) -> tuple:
        return ([],)

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        order, now = row
        held = [t for t in state[0] if t > now - self.window]
        passes = len(held) < self.most
        return (held + [now] * passes,), [(order, passes)]

    def due(self, state: tuple) -> int | None:
        return max(state[0]) + self.window if state[0] else None

    def expire(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        return ([t for t in state[0] if t > now - self.window],), []


class Anchored(Machine):
    """The first call opens a window in which `most` calls pass; the next call after it opens another."""

    state = "opened long, calls long"
    out = "id long, accepted boolean"

    def __init__(self, order: str, at: str, most: int, window: int):
        self.columns, self.most, self.window = (order, at), most, window

    def start(self) -> tuple:
        return None, 0

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        (order, now), (opened, calls) = row, state
        if opened is None or now - opened >= self.window:
            opened, calls = now, 0
        return (opened, calls + 1), [(order, calls + 1 <= self.most)]

    def due(self, state: tuple) -> int | None:
        return None if state[0] is None else state[0] + self.window

    def expire(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        return self.start(), []


class Delayed(Machine):
    """Something is done `wait` after each event, by event time. In batch nothing is due before the end."""

    state = "ids array<long>, due array<long>"
    out = "id long, due_at long"

    def __init__(self, order: str, at: str, wait: int):
        self.columns, self.wait = (order, at), wait

    def start(self) -> tuple:
        return [], []

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        return (state[0] + [row[0]], state[1] + [row[1] + self.wait]), []

    def due(self, state: tuple) -> int | None:
        return min(state[1], default=None)

    def expire(self, state: tuple, now: int) -> tuple[tuple, list[tuple]]:
        both = list(zip(*state, strict=True))
        left = [x for x in both if x[1] > now]
        return ([x[0] for x in left], [x[1] for x in left]), [x for x in both if x[1] <= now]


class Unacknowledged(Machine):
    """Chunks that wait for their acknowledgement, by number, and what a reconnect sends again.

    send gives a chunk the next number and sends it; ack drops all up to a number (acks of what was never sent are
    ignored); lost closes the connection, and the n-th reconnect in a row comes min(base * 2 ** (n - 1), most) later and
    sends every chunk that is still waiting, in order. What is sent while there is no connection is only kept.
    """

    state = "next long, waiting array<long>, attempts int, open_at long"
    out = "id long, number long, again boolean, sent_at long"

    def __init__(self, kind: str, order: str, upto: str, at: str, base: int, most: int):
        self.columns, self.base, self.most = (kind, order, upto, at), base, most

    def start(self) -> tuple:
        return 1, [], 0, 0

    def step(self, state: tuple, row: tuple) -> tuple[tuple, list[tuple]]:
        kind, order, upto, now = row
        after, waiting, attempts, open_at = state
        out: list[tuple] = []
        if open_at and now >= open_at:
            out += [(order, n, True, open_at) for n in waiting]
            open_at = 0
        if kind == "send":
            waiting = [*waiting, after]
            if not open_at:
                out.append((order, after, False, now))
            after += 1
        elif kind == "ack" and not open_at:
            waiting, attempts = [n for n in waiting if n > upto or upto >= after], 0 if 0 < upto < after else attempts
        elif kind == "lost" and not open_at:
            attempts += 1
            open_at = now + min(self.base << (attempts - 1), self.most)
        return (after, waiting, attempts, open_at), out


def arrow_schema(schema: str) -> pa.Schema:
    return to_arrow_schema(StructType.fromDDL(schema))


def walk(events: DataFrame, keys: list[str], order: list[str], machine: Machine) -> DataFrame:
    """(keys, the machine's rows) of each key's events in order. Null keys are a key; ties go by the event's other columns."""
    kinds = dict(events.dtypes)
    columns = list(dict.fromkeys([*keys, *order, *machine.columns]))
    out = ", ".join([f"`{k}` {kinds[k]}" for k in keys] + [machine.out])
    schema = arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, state, rows = None, machine.start(), []
        for batch in batches:
            for k, row in zip(*[zip(*[batch.column(c).to_pylist() for c in names], strict=True) for names in (keys, machine.columns)], strict=True):
                if k != key:
                    rows += [(*key, *r) for r in machine.last(state)] if key is not None else []
                    key, state = k, machine.start()
                state, made = machine.step(state, row)
                rows += [(*k, *r) for r in made]
            if rows:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in rows], schema)
                rows = []
        if key is not None and (rest := machine.last(state)):
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, (*key, *r), strict=True)) for r in rest], schema)

    ties = [c for c in columns if c not in keys and c not in order]
    return events.select(*columns).repartition(*keys).sortWithinPartitions(*keys, *order, *ties).mapInArrow(run, out)
