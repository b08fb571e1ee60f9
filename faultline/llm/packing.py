"""Mixture-controlled packing: deficit round-robin over source queues into token windows.

Every source is a queue: its documents' tokens, one after the other.  The total order of
windows (sequences of ``seq_len`` tokens) is cut into periods of ``PERIOD_WINDOWS`` windows.
What each queue has served at the start of a period follows in closed form from its target
rate, rounded down, so the deficits that one period leaves to the next are below one token
and any task can work on any period alone.  Inside a period deficit round-robin fills one
window after the other: each queue's deficit grows by its quantum, a queue is served when
its deficit reaches ``min_piece`` tokens (smaller deficits are carried to the next window),
and what room is left goes to the largest deficits.  When a queue of a given target runs
dry, the others share its rate; all tokens are packed and only the last window is short.

Steps: tokenise each document once and write ids with the running total of its queue in
its task; add up totals by (queue, task); then cut each document into pieces where it lies.
Token ids never pass a shuffle unless the table of running totals is too large to broadcast.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import OrderedDict
from fractions import Fraction
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.common import arrow_map
from faultline.session import materialize

SEQ_LEN = 1024
MIN_PIECE = 128
PERIOD_WINDOWS = 64
#: Beyond so many sources, those without a target of their own share queues by a hash of their names.
MAX_QUEUES = 4096
END_ID = 0
#: Periods whose services a task keeps; queues drift apart by some.
_CACHED_PERIODS = 512
#: Documents in one output batch.
_OUT_ROWS = 1024

# Fixed value: the published split pattern of the byte-level BPE vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_tokenizer() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _ranks(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Token bytes and ids of a byte-level BPE file, printable stand-ins back to bytes; and its added tokens."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    byte = {chr(b): b for b in plain}
    byte |= {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    added = {t["content"]: t["id"] for t in model.get("added_tokens", [])}
    return {bytes(byte[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in added}, added


@lru_cache(maxsize=2)
def encoder(path: str):
    """Ids of a text as uint32 bytes, as the file's own library gives them with
    ``add_special_tokens=False``: none is put in, but an added token's name in the text is
    that token.  Made once for each worker process."""
    import tiktoken
    ranks, added = _ranks(path)
    encode = tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=added)
    return lambda text: encode.encode_to_numpy(text, allowed_special="all").astype("<u4").tobytes()


class Schedule:
    """What each queue has served at any period's start, and the services inside a period.

    ``totals``: tokens of each queue; ``targets``: weights by queue (None: the totals, so
    that every window has the corpus's own proportions)."""

    def __init__(self, totals: dict[str, int], targets: dict[str, float] | None = None, seq_len: int = SEQ_LEN,
                 min_piece: int = MIN_PIECE, period_windows: int = PERIOD_WINDOWS):
        self.queues = sorted(q for q, t in totals.items() if t)
        self.number = {q: k for k, q in enumerate(self.queues)}
        self.seq_len, self.min_piece, self.step = seq_len, min_piece, seq_len * period_windows
        left = [totals[q] for q in self.queues]
        # phases: between two queues' ends the rates stay the same
        self.phases: list[tuple[list[int], list[int], int, int]] = []
        base = [0] * len(left)
        while any(left):
            w = [Fraction(targets.get(q, 0)).limit_denominator(10**6) if targets is not None and n else Fraction(n)
                 for q, n in zip(self.queues, left)]
            if not any(w):
                w = [Fraction(n) for n in left]
            scale = 1
            for x in w:
                scale = scale * x.denominator // np.gcd(scale, x.denominator).item() if scale < 2**62 else scale
            weight = [int(x * scale) for x in w]
            whole = sum(weight)
            length = min(-(-n * whole // v) for n, v in zip(left, weight) if v)
            got = [min(n, v * length // whole) for n, v in zip(left, weight)]
            for k, (n, v) in enumerate(zip(left, weight)):
                if v and -(-n * whole // v) == length:
                    got[k] = n
            self.phases.append((base, weight, whole, length))
            base = [b + g for b, g in zip(base, got)]
            left = [n - g for n, g in zip(left, got)]
        self.ends = base
        # periods: (phase, number in the phase); counted over all phases
        self.first_period = [0]
        for _, _, _, length in self.phases:
            self.first_period.append(self.first_period[-1] + -(-length // self.step))
        self._services: OrderedDict[int, dict] = OrderedDict()

    def served(self, period: int) -> list[int]:
        """Tokens that each queue has served before a period."""
        return [self.served_of(k, period) for k in range(len(self.queues))]

    def served_of(self, k: int, period: int) -> int:
        if period >= self.first_period[-1]:
            return self.ends[k]
        p = bisect_right(self.first_period, period) - 1
        base, weight, whole, _ = self.phases[p]
        end = self.phases[p + 1][0][k] if p + 1 < len(self.phases) else self.ends[k]
        return min(end, base[k] + weight[k] * self.step * (period - self.first_period[p]) // whole)

    def period_of(self, k: int, at: int) -> int:
        """The period in which queue ``k`` serves its token ``at``."""
        lo, hi = 0, self.first_period[-1]
        while hi - lo > 1:
            mid = (lo + hi) // 2
            lo, hi = (mid, hi) if self.served_of(k, mid) <= at else (lo, mid)
        return lo

    def services(self, period: int) -> dict[int, list[tuple[int, int, int]]]:
        """For each queue its services in a period: (place in the queue, tokens, place among
        all tokens), in order.  No service crosses the end of a window."""
        if period in self._services:
            self._services.move_to_end(period)
            return self._services[period]
        start, end = self.served(period), self.served(period + 1)
        quota = [b - a for a, b in zip(start, end)]
        total, place = sum(quota), sum(start)
        active = [k for k, n in enumerate(quota) if n]
        served, out = [0] * len(quota), {k: [] for k in active}
        turn, done = 0, 0

        def serve(k: int, n: int) -> None:
            nonlocal place, done, room
            if out[k] and out[k][-1][2] + out[k][-1][1] == place and place % self.seq_len:
                a, b, c = out[k].pop()
                out[k].append((a, b + n, c))
            else:
                out[k].append((start[k] + served[k], n, place))
            served[k] += n
            place, done, room = place + n, done + n, room - n

        while done < total:
            room = min(self.seq_len - place % self.seq_len, total - done)
            upto = done + room
            deficit = {k: quota[k] * upto // total - served[k] for k in active}
            for k in active[turn:] + active[:turn]:
                if deficit[k] >= self.min_piece and room:
                    n = min(deficit[k], room)
                    serve(k, n)
                    deficit[k] -= n
            turn = (turn + 1) % len(active)
            for k in sorted(active, key=lambda k: (-deficit[k], k)):
                n = min(room, quota[k] - served[k], max(deficit[k], self.min_piece))
                if n > 0:
                    serve(k, n)
            for k in active:
                n = min(room, quota[k] - served[k])
                if n > 0:
                    serve(k, n)
        if len(self._services) >= _CACHED_PERIODS:
            self._services.popitem(last=False)
        self._services[period] = out
        return out

    def pieces(self, queue: str, at: int, n: int):
        """(start in the document, tokens, place among all tokens) of a document whose ``n``
        tokens begin at ``at`` in its queue."""
        k, end, first = self.number[queue], at + n, at
        period = self.period_of(k, at)
        while at < end:
            own = self.services(period).get(k, ())
            i = max(0, bisect_right(own, (at, 1 << 62, 0)) - 1)
            while i < len(own) and at < end:
                a, m, place = own[i]
                use = min(end, a + m) - at
                if use > 0:
                    yield at - first, use, place + at - a
                    at += use
                i += 1
            period += 1


def tokenized(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source",
              tokenizer: str | None = None, end_id: int = END_ID, max_queues: int = MAX_QUEUES,
              targets: dict[str, float] | None = None) -> DataFrame:
    """``(id_col, queue, task, at, n, ids)``, written once: ids as little-endian uint32 with
    the end id, and the tokens of the same queue before it in its task.

    A source named in ``targets`` always is a queue of its own; of more than ``max_queues``
    sources the others share that many."""
    path = tokenizer or default_tokenizer()
    name = F.coalesce(F.col(queue_col).cast("string"), F.lit(""))
    if docs.select(name.alias("q")).distinct().limit(max_queues + 1).count() > max_queues:
        shared = "#"  # no target's name begins like a shared queue's
        while any(t.startswith(shared) for t in targets or ()):
            shared += "#"
        bucket = F.concat(F.lit(shared), F.pmod(F.xxhash64(name), F.lit(max_queues)).cast("string"))
        name = F.when(name.isin(list(targets)), name).otherwise(bucket) if targets else bucket
    end = np.array([end_id], "<u4").tobytes()

    def setup():
        from pyspark import TaskContext
        return encoder(path), {}, TaskContext.get().partitionId()

    def rows(state, ids, texts, queues):
        encode, totals, task = state
        for lo in range(0, len(ids), _OUT_ROWS):
            part = slice(lo, lo + _OUT_ROWS)
            tokens = [encode(t or "") + end for t in texts[part]]
            at = []
            for q, b in zip(queues[part], tokens):
                at.append(totals.get(q, 0))
                totals[q] = at[-1] + len(b) // 4
            yield ids[part], queues[part], [task] * len(at), at, [len(b) // 4 for b in tokens], tokens

    d = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("_t"), name.alias("_q"))
    kind = docs.schema[id_col].dataType.simpleString()
    return materialize(arrow_map(d, rows, f"{id_col} {kind}, queue string, task long, at long, n long, ids binary",
                                 setup), "packing-tokens")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", queue_col: str = "source",
         targets: dict[str, float] | None = None, tokenizer: str | None = None, seq_len: int = SEQ_LEN,
         min_piece: int = MIN_PIECE, end_id: int = END_ID, max_queues: int = MAX_QUEUES) -> DataFrame:
    """Pieces of all documents: ``id_col, start, length, ids`` (little-endian uint32),
    ``doc_tokens, sequence_id, offset, queue``.

    Every token, with one end id a document, lies in one piece; offsets of a sequence have
    no gap and every sequence but the last holds ``seq_len`` tokens.  ``targets`` gives the
    token proportions by source (default: the corpus's own); sources without one follow when
    those run dry.  Beyond ``max_queues`` sources, those without a target share queues.  A null text is empty (its end
    id is packed), a null source is the queue ``''``; repeated rows are packed each; an empty
    table gives no rows; other columns are not read.  Proportions: at the end of any window
    a queue is within ``min_piece`` tokens and a few of its target, however many tasks.
    """
    tokens = tokenized(docs, id_col, text_col, queue_col, tokenizer, end_id, max_queues, targets)
    by_task = tokens.groupBy("queue", "task").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("queue").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = materialize(by_task.select("queue", "task", "n", F.coalesce(F.sum("n").over(before), F.lit(0))
                                      .alias("base")), "packing-bases")
    # one number a queue, of which there are at most max_queues besides the targets
    totals = {r["queue"]: r["n"] for r in base.groupBy("queue").agg(F.sum("n").alias("n")).collect()}
    placed = tokens.join(base.drop("n"), ["queue", "task"]) \
        .select(id_col, "queue", (F.col("at") + F.col("base")).alias("at"), "n", "ids")

    def rows(plan, ids, queues, at, n, tokens):
        for lo in range(0, len(ids), _OUT_ROWS):
            out = [[] for _ in range(8)]
            for k in range(lo, min(len(ids), lo + _OUT_ROWS)):
                view = memoryview(tokens[k])
                for start, length, place in plan.pieces(queues[k], at[k], n[k]):
                    for column, v in zip(out, (ids[k], start, length, bytes(view[4 * start:4 * (start + length)]), n[k],
                                               place // seq_len, place % seq_len, queues[k])):
                        column.append(v)
            yield tuple(out)

    kind = docs.schema[id_col].dataType.simpleString()
    return arrow_map(placed, rows, f"{id_col} {kind}, start long, length long, ids binary, doc_tokens long, "
                                   "sequence_id long, offset long, queue string",
                     setup=lambda: Schedule(totals, targets, seq_len, min_piece))


def sequences(pieces: DataFrame, seq_len: int = SEQ_LEN) -> DataFrame:
    """``(sequence_id, ids, length, padded_length)``: a sequence's pieces put together, at most
    ``seq_len`` tokens a group.  It is padded to ``seq_len``, except at a power of two."""
    got = pieces.groupBy("sequence_id").agg(
        F.sort_array(F.collect_list(F.struct("offset", "length", "ids"))).alias("p"))
    n = F.aggregate("p", F.lit(0).cast("long"), lambda a, p: a + p["length"])
    ids = F.aggregate("p", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return got.select("sequence_id", ids.alias("ids"), n.alias("length")).withColumn(
        "padded_length", F.when(F.expr("bit_count(length) = 1"), F.col("length")).otherwise(seq_len))
