"""Least-cost repair of the roles in a conversation, and its rendering.

A legal conversation is an optional system turn, then user and assistant in turns, from user to assistant. Each turn
either keeps its role or is relabelled; a turn with the role of the one before merges into it; where the automaton
would need a turn in between, an empty one is inserted. Dynamic programming picks the cheapest choice.

A step of the programme is a (min, +) matrix over the automaton's states, and products of such matrices are again
matrices. So a conversation is cut into blocks: each block gives one small matrix, the matrices of a conversation are
chained, and each block is traced back alone between its two fixed states. No block holds more than BLOCK turns.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.operators.ordered import with_position
from tabulon.session import cut_lineage, shuffle_width

ROLES = ("system", "user", "assistant")
BLOCK = 1024
#: Turns of one task on average; blocks are dealt to tasks by hash, roles only.
TASK_TURNS = 20_000
#: Costs in whole numbers. A merge is cheapest, an invented turn dearest; an unknown role is free to relabel.
MERGE, RELABEL, INSERT = 1, 3, 4
_FAR = 1 << 40
_START = 3
#: What is inserted between the role before (or the start, 3) and the next role; absent pairs need a merge or nothing.
_BETWEEN = {(s, r): ins for s, r, ins in [
    (_START, 0, ()), (_START, 1, ()), (_START, 2, (1,)),
    (0, 0, ()), (0, 1, ()), (0, 2, (1,)),
    (1, 1, ()), (1, 2, ()), (2, 1, ()), (2, 2, ())]}
# Two user turns or two assistant turns in a row may also be parted by an empty turn of the other role.
_PARTED = {(1, 1): (2,), (2, 2): (1,)}


def _steps(state: int, old: int) -> list[tuple[int, int, str, tuple[int, ...]]]:
    """(cost, new role, action, inserted roles) for a turn whose role number is `old` (-1: unknown)."""
    out = []
    for role in range(3):
        change = 0 if role == old or old < 0 else RELABEL
        name = "keep" if role == old else "relabel"
        between = _BETWEEN.get((state, role))
        if between is not None:
            same = state == role
            out.append((change + (MERGE if same else 0) + INSERT * len(between), role, f"{name}+merge" if same else name, between))
        if (state, role) in _PARTED:
            out.append((change + INSERT, role, name, _PARTED[state, role]))
    return out


#: The steps of every state and role number, worked out once.
_STEPS = {(state, old): _steps(state, old) for state in range(4) for old in range(-1, 3)}


def _forward(roles: list[int], entry: int) -> list[list[int]]:
    """Least cost of each state after each turn, from one entry state."""
    best = [_FAR] * 4
    best[entry] = 0
    rows = [best]
    for old in roles:
        now = [_FAR] * 4
        for state in range(4):
            if rows[-1][state] < _FAR:
                for cost, role, _, _ in _STEPS[state, old]:
                    now[role] = min(now[role], rows[-1][state] + cost)
        rows.append(now)
    return rows


def _trace(roles: list[int], entry: int, leave: int) -> list[tuple[int, str, tuple[int, ...], int]]:
    """(new role, action, inserted roles, state before) of each turn on the cheapest way between two states. Of equal
    ways, the one through the lower states, from the end."""
    rows, out, state = _forward(roles, entry), [], leave
    for i in range(len(roles), 0, -1):
        for before in range(4):
            step = next((s for s in _STEPS[before, roles[i - 1]]
                         if s[1] == state and rows[i - 1][before] + s[0] == rows[i][state]), None)
            if rows[i - 1][before] < _FAR and step:
                out.append((state, step[2], step[3], before))
                state = before
                break
    return out[::-1]


def _sorted_groups(pdf: pd.DataFrame, keys: list[str], order: str) -> tuple[pd.DataFrame, list[tuple[int, int]]]:
    """The rows by group and place, and where each group begins and ends."""
    pdf = pdf.sort_values([*keys, order], kind="stable", ignore_index=True)
    fresh = np.zeros(len(pdf), bool)
    fresh[:1] = True
    for key in keys:
        values = pdf[key].to_numpy()
        fresh[1:] |= values[1:] != values[:-1]
    heads = np.flatnonzero(fresh).tolist()
    return pdf, list(zip(heads, [*heads[1:], len(pdf)]))


def _block_costs(pdf: pd.DataFrame) -> pd.DataFrame:
    """For each block, the least cost from each state to each state, row by row."""
    pdf, groups = _sorted_groups(pdf, ["conversation", "block"], "position")
    roles = pdf["role"].tolist()
    heads = [a for a, _ in groups]
    return pd.DataFrame({
        "conversation": pdf["conversation"].to_numpy()[heads], "block": pdf["block"].to_numpy()[heads],
        "costs": [[c for entry in range(4) for c in _forward(roles[a:z], entry)[-1]] for a, z in groups]})


def _chain(pdf: pd.DataFrame) -> pd.DataFrame:
    """States at the borders of a conversation's blocks: one small matrix for each block goes in."""
    pdf, groups = _sorted_groups(pdf, ["conversation"], "block")
    matrices = pdf["costs"].tolist()
    enter, leave, last, cost = ([None] * len(pdf) for _ in range(4))
    for a, z in groups:
        rows = [[_FAR, _FAR, _FAR, 0]]
        for costs in matrices[a:z]:
            rows.append([min(min(rows[-1][x] + costs[4 * x + y] for x in range(4)), _FAR) for y in range(4)])
        # An open user turn or a lone system turn gets the empty turns that close the conversation.
        closing = {0: 2 * INSERT, 1: INSERT, 2: 0, 3: _FAR}
        state = min(range(4), key=lambda s: (rows[-1][s] + closing[s], s))
        total = rows[-1][state] + closing[state]
        for i in range(z - 1, a - 1, -1):
            before = min(range(4), key=lambda x: (rows[i - a][x] + matrices[i][4 * x + state], x))
            enter[i], leave[i], last[i], cost[i] = before, state, i == z - 1, total
            state = before
    return pd.DataFrame({"conversation": pdf["conversation"], "block": pdf["block"], "enter": enter, "leave": leave, "last": last, "cost": cost})


def _repair_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf, groups = _sorted_groups(pdf, ["conversation", "block"], "position")
    roles, enter, leave, last = (pdf[c].tolist() for c in ("role", "enter", "leave", "last"))
    new, action, before, after = [], [], [], []
    for a, z in groups:
        found = _trace(roles[a:z], int(enter[a]), int(leave[a]))
        new += [f[0] for f in found]
        action += [f[1] for f in found]
        before += [list(f[2]) for f in found]
        after += [[]] * (len(found) - 1) + [list({0: (1, 2), 1: (2,), 2: ()}[int(leave[a])] if last[a] else ())]
    return pd.DataFrame({
        "conversation": pdf["conversation"], "position": pdf["position"], "new": new, "action": action, "before": before,
        "after": after, "merged": ["merge" in x for x in action], "cost": pdf["cost"]})


def repair_roles(turns: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
                 block: int = BLOCK) -> DataFrame:
    """One row for each input turn, in the order `position` (0 on) inside its conversation, with the input columns and
    `new_role`, `action` (keep, relabel, each with +merge where the turn joins the one before), `n_inserted`, `cost`
    (of the whole conversation) and `rendered`: this turn's part of the rendering, so that the parts joined by position
    give the conversation and no task holds all of it.

    Turns are ordered by turn number (nulls last), then role and text. Role names are matched without regard to case
    and outer blanks; a null or other role is unknown and takes the cheapest. A null conversation id is one
    conversation of its own; null texts render as empty. Repeated rows are turns of their own. The names of the new
    columns must be free."""
    new = {"position", "new_role", "action", "n_inserted", "cost", "rendered"}
    if new & set(turns.columns):
        raise ValueError(f"columns exist: {sorted(new & set(turns.columns))}")
    names = turns.columns
    number = F.lit(-1)
    for i, r in enumerate(ROLES):
        number = F.when(F.lower(F.trim(F.col(role))) == r, F.lit(i)).otherwise(number)
    keyed = turns.select(
        *[F.col(c).alias(f"in_{i}") for i, c in enumerate(names)],
        F.coalesce(F.concat(F.lit("c"), F.col(conversation).cast("string")), F.lit("n")).alias("conversation"),
        F.when(F.col(turn).isNull(), 1).otherwise(0).alias("late"), F.coalesce(F.col(turn).cast("long"), F.lit(0)).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("r"), F.xxhash64(text).alias("t"), number.cast("int").alias("role"))
    placed = cut_lineage(with_position(keyed, ["conversation"], ["late", "turn", "r", "t"]).withColumn(
        "block", F.floor(F.col("position") / block).cast("long")))
    slim = placed.select("conversation", "block", "position", "role")
    key = "conversation string, block long"
    tasks = max(shuffle_width(turns.sparkSession), placed.count() // TASK_TURNS)

    def dealt(df: DataFrame, *by: str):
        """Groups that are one task each: a number of partitions that is asked for stays, however few bytes they hold."""
        return df.withColumn("task", F.pmod(F.xxhash64(*by), F.lit(tasks))).repartition(tasks, "task").groupBy("task")

    costs = dealt(slim, "conversation", "block").applyInPandas(_block_costs, f"{key}, costs array<long>")
    borders = dealt(costs, "conversation").applyInPandas(_chain, f"{key}, enter int, leave int, last boolean, cost long")
    repaired = dealt(slim.join(cut_lineage(borders), ["conversation", "block"]), "conversation", "block").applyInPandas(
        _repair_blocks, "conversation string, position long, new int, action string, before array<int>, after array<int>, "
                        "merged boolean, cost long")
    repaired = cut_lineage(repaired)
    found = placed.join(repaired, ["conversation", "position"])
    role_name = F.array(*[F.lit(r) for r in ROLES])
    empty = lambda roles: F.array_join(F.transform(roles, lambda r: F.concat(F.lit("<|"), role_name[r], F.lit("|>\n<|end|>\n"))), "")
    body = F.coalesce(F.col(f"in_{names.index(text)}"), F.lit(""))
    rendered = F.concat(
        empty("before"),
        F.when(F.col("merged"), F.lit("\n")).otherwise(F.concat(F.lit("<|"), role_name[F.col("new")], F.lit("|>\n"))),
        body, F.when(F.coalesce("joined", F.lit(False)), F.lit("")).otherwise(F.lit("<|end|>\n")), empty("after"))
    # Whether the next turn joins this one: its row, moved one place up.
    joined = repaired.select("conversation", (F.col("position") - 1).alias("position"), F.col("merged").alias("joined"))
    return found.join(joined, ["conversation", "position"], "left").select(
        *[F.col(f"in_{i}").alias(c) for i, c in enumerate(names)], "position", role_name[F.col("new")].alias("new_role"), "action",
        (F.size("before") + F.size("after")).cast("long").alias("n_inserted"), "cost", rendered.alias("rendered"))

