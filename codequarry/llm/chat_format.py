"""Chat formatting with the least costly repair of the roles.

A legal conversation is an optional system turn, then user and assistant turns in alternation, ending with the assistant. Dynamic
programming over the turns and the states of that automaton (start, system, user, assistant) finds the cheapest way to make a
conversation legal: merge a turn into the one before, give it another role, or put an empty turn in. The
repaired turns are then rendered, each as <|role|>, its text and <|end|> on lines of their own.

Costs: merge 1, relabel 2 (1 for an unknown role, merged turns of another role too), empty turn 3. Equal costs: keep, then merge,
relabel, insert, in that order at the latest turn where ways differ; then roles in the order system, user, assistant.

Defined results: rows without conv_id are ignored; turns are sorted by turn, role and text, nulls first; repeated rows count
once; null roles are unknown, null texts empty; human is user, gpt, bot and model are assistant, in any case. Other columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codequarry.session import ship

ROLES = ("system", "user", "assistant")
ALIAS = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"} | {r: r for r in ROLES}
NEXT = {"start": ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}
MERGE, RELABEL, RELABEL_UNKNOWN, INSERT = 1, 2, 1, 3


def repair(roles: list[str | None]) -> tuple[int, list[tuple[str, str, int | None]]]:
    """Least cost, and steps (what, role, turn) with what in keep, merge, relabel, insert."""
    best: dict[str, tuple[int, tuple | None]] = {"start": (0, None)}

    def insertions(states: dict) -> dict:
        """Also reach states through empty turns: at most two in a row are ever of use."""
        for _ in range(2):
            for state, (cost, path) in list(states.items()):
                for role in NEXT[state]:
                    if role not in states or states[role][0] > cost + INSERT:
                        states[role] = (cost + INSERT, (path, ("insert", role, None)))
        return states

    for turn, said in enumerate(roles):
        own = ALIAS.get((said or "").strip().lower())
        change = RELABEL if own else RELABEL_UNKNOWN
        ways: dict[str, tuple[int, int, tuple]] = {}

        def offer(state: str, cost: int, order: int, path: tuple, ways=ways) -> None:
            if state not in ways or (cost, order) < ways[state][:2]:
                ways[state] = (cost, order, path)

        for state, (cost, path) in insertions(dict(best)).items():
            for role in NEXT[state]:
                if role == own:
                    offer(role, cost, 0, (path, ("keep", role, turn)))
                else:
                    offer(role, cost + change, 2, (path, ("relabel", role, turn)))
            if state != "start":
                offer(state, cost + MERGE + (0 if state == own else change), 1, (path, ("merge", state, turn)))
        best = {s: (c, p) for s, (c, _, p) in ways.items()}
    if roles:
        best = insertions(best)
    cost, path = best.get("assistant", (0, None)) if roles else (0, None)
    steps = []
    while path:
        path, step = path
        steps.append(step)
    return cost, steps[::-1]


def render(steps: list[tuple[str, str, int | None]], texts: list[str | None]) -> tuple[list[str], str]:
    """Roles of the repaired conversation, and its text."""
    turns: list[tuple[str, list[str]]] = []
    for what, role, turn in steps:
        text = [] if turn is None else [texts[turn] or ""]
        if what == "merge":
            turns[-1][1].extend(text)
        else:
            turns.append((role, text))
    return [r for r, _ in turns], "".join(f"<|{r}|>\n" + "\n".join(t) + "\n<|end|>\n" for r, t in turns)


def _format(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("cost", "edits", "roles", "text")}
        for turns in batch.column("turns").to_pylist():
            cost, steps = repair([t["role"] for t in turns])
            roles, text = render(steps, [t["text"] for t in turns])
            edits = [f"{what} {role}" + ("" if turn is None else f" {turn}") for what, role, turn in steps if what != "keep"]
            for k, v in (("cost", cost), ("edits", edits), ("roles", roles), ("text", text)):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out["cost"], pa.int32()), pa.array(out["edits"], pa.list_(pa.string())), pa.array(out["roles"], pa.list_(pa.string())), pa.array(out["text"], pa.string())], ["conv_id", "cost", "edits", "roles", "text"])


def format_chats(conversations: DataFrame) -> DataFrame:
    """(conv_id, cost, edits, roles, text) of every conversation."""
    ship(conversations.sparkSession)
    rows = conversations.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.struct(F.col("turn"), F.col("role"), F.col("text")).alias("t"))
    chats = rows.groupBy("conv_id").agg(F.array_distinct(F.sort_array(F.collect_list("t"))).alias("turns"))
    return chats.mapInArrow(_format, "conv_id long, cost int, edits array<string>, roles array<string>, text string")
