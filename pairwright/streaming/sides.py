"""Blocks of two sources over batches, one of them small: the small source's kept postings are an index that every worker has, so the
large source's profiles meet it where they are read and none of their postings or pairs is shuffled.

The same blocks as `incremental.Blocks` with sizes, tokens hashed: a token is banned from the first arrival that finds rho times the
size of its own source, less one, on the other side. Only tokens that the index has can be banned or make pairs. How many of the large
source came before each arrival of the small one is counted by workers, in the gaps between these arrivals.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pairwright.functions.text import token_sets
from pairwright.operators import packed

from .state import Table

#: Profiles of the small source at most; its postings are on the driver and in every worker.
SMALL = 10_000
#: Profiles of the large source times those of the small one that a worker counts at a time (8 bytes each).
CELLS = 4_000_000

POSTING = "token long, id long, seq long"
PAIRS = "e1 long, e2 long, cbs long, late boolean"
NEVER = np.iinfo(np.int64).max


def _flat(batch: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """Of profiles (id, seq, tokens): ids, arrivals, tokens end to end and whose they are."""
    size = np.diff(batch.column(2).offsets.to_numpy())
    return batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).flatten().to_numpy(), np.repeat(np.arange(len(size)), size)


def _places(known: np.ndarray, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which tokens are known, and where these stand."""
    if not len(known):
        return np.empty(0, np.int64), np.empty(0, np.int64)
    at = np.minimum(np.searchsorted(known, tokens), len(known) - 1)
    mine = np.flatnonzero(known[at] == tokens)
    return mine, at[mine]


def _gaps(index, before: bool):
    """How many arrivals of the large source fall into each gap: gap i is right before posting i of the small one (token, seq, id in
    this order). before: they came with earlier batches, so ahead of all."""

    def run(batches):
        names, starts, token, seq, id_ = index.value
        out = np.zeros(len(token) + 1, np.int64)
        bounds = np.rec.fromarrays((token, seq, id_))
        for batch in batches:
            ids, seqs, flat, owner = _flat(batch)
            mine, at = _places(names, flat)
            if before:
                place = starts[at]
            else:
                rows = np.rec.fromarrays((flat[mine], seqs[owner[mine]], ids[owner[mine]]), dtype=bounds.dtype)
                order = np.lexsort((np.concatenate((id_, rows.f2)), np.concatenate((seq, rows.f1)), np.concatenate((token, rows.f0))))
                ours = order < len(token)
                upto = np.cumsum(ours)
                theirs = ~ours
                place, owners = upto[theirs], rows.f0[order[theirs] - len(token)]
                place = place[(place < len(token)) & (token[np.minimum(place, len(token) - 1)] == owners)]  # behind a token's last: in no gap
            out += np.bincount(place, minlength=len(out))
        met = np.flatnonzero(out)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(out[met])], names=["gap", "n"])

    return run


def _following(after):
    """The first arrival of the large source with each of some tokens behind a given one."""

    def run(batches):
        names, since = after.value
        out = np.full(len(names), NEVER)
        for batch in batches:
            _, seqs, flat, owner = _flat(batch)
            mine, at = _places(names, flat)
            late = seqs[owner[mine]] > since[at]
            np.minimum.at(out, at[late], seqs[owner[mine[late]]])
        met = np.flatnonzero(out < NEVER)
        yield pa.RecordBatch.from_arrays([pa.array(names[met]), pa.array(out[met])], names=["token", "seq"])

    return run


def _met(index, mean: bool, first: bool, old: bool):
    """Pairs of profiles of the large source with the index, counted; late: those whose small end arrived last, the others cleaned by the
    mean of their large end if asked. first: the small source is the first one. old: profiles of earlier batches, whose pairs with
    earlier arrivals are known."""

    def run(batches):
        names, starts, seq, number, fresh, ban, ids2 = index.value
        many = np.diff(starts)

        def counted(ids, seqs, at, owner):
            width = 2 * len(ids2)
            low = int(owner[0])
            n = many[at]
            who = np.repeat(owner, n)
            member = np.arange(len(who)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(starts[at], n)
            came, mine = seqs[who], seq[member]
            late = (mine > came) & fresh[member]
            keep = late if old else late | (mine < came)
            key = ((who - low) * width + 2 * number[member] + late)[keep]
            counts = np.bincount(key)
            at = np.flatnonzero(counts)
            cbs, who, late = counts[at], at // width, at % 2 == 1
            if mean and not old:
                sums, pairs = np.bincount(who, weights=cbs * ~late), np.bincount(who, weights=~late)
                keep = late | (cbs >= (sums / np.maximum(pairs, 1))[who])
                at, cbs, who, late = at[keep], cbs[keep], who[keep], late[keep]
            ends = [pa.array(ids[who + low]), pa.array(ids2[at % width // 2])]
            return pa.RecordBatch.from_arrays([*(ends[::-1] if first else ends), pa.array(cbs), pa.array(late)], names=["e1", "e2", "cbs", "late"])

        for batch in batches:
            ids, seqs, flat, owner = _flat(batch)
            mine, at = _places(names, flat)
            owner = owner[mine]
            if not old:
                kept = seqs[owner] < ban[at]
                at, owner = at[kept], owner[kept]
            raw, begun = np.cumsum(many[at]), 0
            most = max(1, CELLS // max(1, 2 * len(ids2)))
            while begun < len(at):  # whole profiles, so that each one's pairs are counted at once
                done = raw[begun - 1] if begun else 0
                last = owner[min(len(at) - 1, int(np.searchsorted(raw, done + packed.SLICE, "right")))]
                last = max(owner[begun] + 1, min(last, owner[begun] + most))
                to = int(np.searchsorted(owner, last))
                yield counted(ids, seqs, at[begun:to], owner[begun:to])
                begun = to

    return run


class Sides:
    """Both sources' profiles over batches."""

    def __init__(self, spark: SparkSession, sizes: tuple[int, int], rho: float):
        self.spark, self.small = spark, int(sizes[1] <= sizes[0])
        self.limits = tuple(rho * n for n in sizes)
        self.sets = Table(spark, "sets", "id long, seq long, tokens array<long>")
        self.postings, self.bans = Table(spark, "small-postings", POSTING), Table(spark, "bans", "token long")

    def _banned(self, large: DataFrame, number: int, fresh: np.ndarray, known: np.ndarray) -> dict[int, int]:
        """The arrival from which each token that this batch bans is banned. Both: rows (token, seq, id) in order."""
        context, out = self.spark.sparkContext, {}
        if len(fresh):
            names, starts = np.unique(fresh[:, 0], return_index=True)
            index = context.broadcast((names, starts, *fresh.T.copy()))
            gaps = large.mapInArrow(_gaps(index, False), "gap long, n long")
            if number:
                gaps = gaps.union(self.sets.before(number).mapInArrow(_gaps(index, True), "gap long, n long"))
            table = gaps.groupBy("gap").agg(F.sum("n").alias("n")).toArrow()
            index.destroy()
            n = np.zeros(len(fresh) + 1, np.int64)
            n[table["gap"].to_numpy()] = table["n"].to_numpy()
            total = np.concatenate(([0], np.cumsum(n[:-1])))
            met = total[1:] - np.repeat(total[starts], np.diff(np.append(starts, len(fresh))))
            ban = np.flatnonzero((met >= 1) & (met + 1 >= self.limits[self.small]))
            for token, seq in fresh[ban[::-1], :2].tolist():  # the first of a token is written last
                out[token] = seq
        least = max(1, ceil(self.limits[1 - self.small]) - 1)
        names, counts = np.unique(np.concatenate((known[:, 0], fresh[:, 0])), return_counts=True)
        names = names[counts >= least]
        if len(names):
            held = np.searchsorted(known[:, 0], names, "right") - np.searchsorted(known[:, 0], names, "left")
            at = np.searchsorted(fresh[:, 0], names) + least - 1 - held
            since = np.where(held >= least, np.iinfo(np.int64).min, fresh[np.clip(at, 0, max(len(fresh) - 1, 0)), 1] if len(fresh) else 0)
            after = context.broadcast((names, since))
            table = large.mapInArrow(_following(after), "token long, seq long").groupBy("token").agg(F.min("seq").alias("seq")).toArrow()
            after.destroy()
            for token, seq in zip(table["token"].to_pylist(), table["seq"].to_pylist(), strict=True):
                out[token] = min(seq, out.get(token, seq))
        return out

    def pairs(self, batch: DataFrame, number: int, mean: bool) -> DataFrame:
        """(e1, e2, cbs, late) of the new pairs of a batch; late: the small end arrived last. mean: the others are at or above the mean of
        their large end."""
        rows = lambda df: np.stack([df[c].to_numpy().astype(np.int64) for c in ("token", "seq", "id")], axis=1).reshape(-1, 3)
        ordered = lambda x: x[np.lexsort((x[:, 2], x[:, 1], x[:, 0]))]
        sets = token_sets(batch, hashed=True)
        large = self.sets.write(sets.where(F.col("ds") != self.small).select("id", "seq", "tokens"), number)
        gone = self.bans.before(number).toArrow()["token"].to_numpy()
        alive = lambda x: ordered(x[~np.isin(x[:, 0], gone)])
        fresh = alive(rows(sets.where(F.col("ds") == self.small).select(F.explode("tokens").alias("token"), "seq", "id").toArrow()))
        known = alive(rows(self.postings.before(number).toArrow()))
        bans = self._banned(large, number, fresh, known)
        kept = fresh[fresh[:, 1] < np.array([bans.get(t, NEVER) for t in fresh[:, 0].tolist()], np.int64)]
        write = lambda table, columns, schema: table.write(self.spark.createDataFrame(pa.table(columns), schema), number)
        write(self.postings, {"token": kept[:, 0], "id": kept[:, 2], "seq": kept[:, 1]}, POSTING)
        write(self.bans, {"token": np.array(sorted(bans), np.int64)}, "token long")
        every = np.concatenate((known, kept))
        new = np.arange(len(every)) >= len(known)
        by = np.argsort(every[:, 0], kind="stable")
        every, new = every[by], new[by]
        names, starts = np.unique(every[:, 0], return_index=True)
        ids, at = np.unique(every[:, 2], return_inverse=True)
        ban = np.array([bans.get(t, NEVER) for t in names.tolist()], np.int64)
        index = self.spark.sparkContext.broadcast((names, np.append(starts, len(every)), every[:, 1].copy(), at.reshape(-1), new, ban, ids))
        met = lambda df, old: df.mapInArrow(_met(index, mean, self.small == 0, old), PAIRS)
        out = met(large, False)
        return out.union(met(self.sets.before(number), True)) if number and len(kept) else out
