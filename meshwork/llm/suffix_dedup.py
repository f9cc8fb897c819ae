"""Removal of byte strings that also start in a document with a smaller id, by suffix grouping.

1. Anchors. Of the SPAN-byte strings of a text, each selects the smallest hash of
   the GRAM-byte strings inside it (the last of ties), so that equal strings select
   equal anchors. An anchor's context is all that the strings which may select it
   cover. Anchors meet by hash; of rows with equal contexts all but those of the
   smallest id are covered as a whole. Tasks settle this for their own rows before
   the shuffle, which leaves one row for each task and context.
2. Suffix groups. The distinct contexts of an anchor that has several are laid one
   after the other and their suffixes sorted by linear grouping construction:
   suffixes are gathered in groups by their Lyndon prefix, the groups are processed
   in descending order, each one extending the prefixes of the suffixes that its
   members' previous-smaller pointers name; then the groups' order is emitted in one
   ascending pass along the same pointers, without recursive renaming. Equal strings
   are then neighbours. An anchor with more contexts than HOT_CONTEXTS is settled by
   an aggregation over its strings instead, so that no group lies in one task.
3. The covered intervals of each document are merged, and the rest is kept.

Defined results: a null text is empty; texts shorter than SPAN bytes lose nothing;
rows that repeat a doc_id remove nothing of each other, as no id is smaller; doc_id
is a whole number, and a null one comes after all others; an empty table gives no
rows; other columns are not read, and `remove` keeps them whatever they are called,
but a column that is named as one of its results gives way to it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from meshwork.llm.common import set_aside, shared_dir, stored

SPAN, GRAM = 50, 20
BACK = SPAN - GRAM  # an anchor lies so many bytes behind the start of a string that selects it at most
CONTEXT = BACK + SPAN
PAD = 2 * CONTEXT
#: Bytes of text hashed at a time, and characters whose suffixes are sorted at a time.
BUFFER, SORT_CHARS = 1 << 18, 1 << 17
#: Anchors that a task settles and deals at a time.
HELD = 300_000
#: Bytes of text for each part that anchors are dealt to by hash, and fewest and most parts.
PART_BYTES, LEAST_PARTS, MOST_PARTS = 1 << 21, 4096, 1 << 24
HOT_CONTEXTS = 20_000
NOBODY = (1 << 63) - 1
RESULTS = ("n_bytes", "n_removed", "n_spans", "kept")

_MIX = np.uint64(0x9E3779B97F4A7C15)
_TABLES = np.random.default_rng(20).integers(0, 1 << 64, (2, 257), dtype=np.uint64)
_POWERS = {e: np.uint64(pow(int(_MIX), e, 1 << 64)) for e in (1, 2, 4, 8, 16, 32, 64)}
ANCHOR = np.dtype([("hash", "<u8"), ("context", "<u8"), ("doc", "<i8"), ("body", "<i8"), ("at", "<u4")])


def rolled(codes: np.ndarray, table: int) -> dict[int, np.ndarray]:
    """Hashes of all strings of 4, 16 and 64 codes, each size from two halves of it."""
    out: dict[int, np.ndarray] = {}
    h = _TABLES[table][codes]
    for s in (1, 2, 4, 8, 16, 32):
        h = h[:-s] * _POWERS[s] + h[s:]
        if 2 * s in (4, 16, 64):
            out[2 * s] = h
    return out


def joined(h: dict[int, np.ndarray], at: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """Hashes of the strings at some places whose length is a sum of powers of two, the largest first."""
    out, k = h[sizes[0]][at], sizes[0]
    for s in sizes[1:]:
        out = out * _POWERS[s] + h[s][at + k]
        k += s
    return out


def anchors(docs: list[tuple[int, int, bytes]]) -> np.ndarray:
    """ANCHOR rows of some documents (doc, body, text), hashed in one buffer with gaps between them."""
    docs = [x for x in docs if len(x[2]) >= SPAN]
    if not docs:
        return np.zeros(0, ANCHOR)
    lengths = np.array([len(x[2]) for x in docs])
    starts = np.cumsum(np.r_[PAD, lengths[:-1] + PAD])
    codes = np.full(int(starts[-1] + lengths[-1] + PAD), 256, np.int16)
    for start, x in zip(starts, docs, strict=True):
        codes[start : start + len(x[2])] = np.frombuffer(x[2], np.uint8)
    one, two = rolled(codes, 0), rolled(codes, 1)
    n = len(codes) - GRAM + 1
    gram = one[16][:n] * _POWERS[4] + one[4][16 : 16 + n]
    gram = (gram ^ (gram >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    gram ^= gram >> np.uint64(32)
    # The low bits hold the distance from the end: the last of equal hashes is the smallest key.
    key = (gram & np.uint64(0xFFFFFFFFFF000000)) | (np.uint64(n) - np.arange(n, dtype=np.uint64))
    low = key
    for s in (1, 2, 4, 8):
        low = np.minimum(low[:-s], low[s:])
    low = np.minimum(low[: -(BACK - 15)], low[BACK - 15 :])  # over BACK + 1 starts
    inside = np.repeat(starts - np.cumsum(np.r_[0, lengths[:-1] - SPAN + 1]), lengths - SPAN + 1) + np.arange((lengths - SPAN + 1).sum())
    at = np.unique(n - (low[inside] & np.uint64(0xFFFFFF)).astype(np.int64))
    owner = np.searchsorted(starts, at, side="right") - 1
    out = np.zeros(len(at), ANCHOR)
    out["hash"] = gram[at]
    out["context"] = joined(one, at - BACK, (64, 16)) * np.uint64(0xD6E8FEB86659FD93) ^ joined(two, at - BACK, (64, 16))
    out["doc"] = np.array([x[0] for x in docs])[owner]
    out["body"] = np.array([x[1] for x in docs])[owner]
    out["at"] = at - starts[owner]
    return out


def text_anchors(doc: int, body: int, text: bytes) -> Iterator[np.ndarray]:
    """ANCHOR rows of a text longer than BUFFER, from overlapping stretches."""
    for start in range(0, len(text), BUFFER):
        lo, hi = max(0, start - PAD), min(len(text), start + BUFFER + PAD)
        found = anchors([(doc, body, text[lo:hi])])
        at = found["at"].astype(np.int64) + lo
        # A stretch answers for the anchors in its middle; those have their whole context in it.
        mine = (at >= start) & (at < start + BUFFER)
        found["at"] = at
        yield found[mine]


def settle(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Split ANCHOR rows into the first of each context and the rows that a smaller id covers as a whole."""
    rows = rows[np.lexsort((rows["at"], rows["doc"], rows["context"], rows["hash"]))]
    new = np.r_[True, (rows["hash"][1:] != rows["hash"][:-1]) | (rows["context"][1:] != rows["context"][:-1])]
    least = rows["doc"][np.nonzero(new)[0]][np.cumsum(new) - 1]
    return rows[rows["doc"] == least], rows[rows["doc"] > least]


def spots(rows: np.ndarray) -> tuple[list[pa.Array], list[str]]:
    """Rows of one document as one row: doc, body and the places as packed bytes."""
    rows = rows[np.lexsort((rows["at"], rows["body"], rows["doc"]))]
    new = np.nonzero(np.r_[True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["body"][1:] != rows["body"][:-1])])[0] if len(rows) else np.zeros(0, int)
    ends = np.r_[new[1:], len(rows)] if len(rows) else new
    return [pa.array(rows["doc"][new]), pa.array(rows["body"][new]), pa.array([rows["at"][a:b].tobytes() for a, b in zip(new, ends, strict=True)], pa.binary())], ["doc", "body", "spots"]


PACKED = "part int, rows binary, doc long, body long, spots binary"


def parts_for(n_bytes: int) -> int:
    """How many parts a corpus of so many bytes is dealt to, so that a part stays about as large whatever the corpus."""
    return min(MOST_PARTS, max(LEAST_PARTS, 1 << (n_bytes // PART_BYTES).bit_length()))


def packed(parts: np.ndarray, blobs: list[bytes], covered: np.ndarray, n_parts: int) -> pa.RecordBatch:
    columns, _ = spots(covered)
    n, m = len(blobs), len(columns[0])
    none = lambda k, t: pa.nulls(k, t)
    return pa.RecordBatch.from_arrays(
        [pa.concat_arrays([pa.array(parts, pa.int32()), pa.array(columns[0].to_numpy() % n_parts, pa.int32())]), pa.concat_arrays([pa.array(blobs, pa.binary()), none(m, pa.binary())])]
        + [pa.concat_arrays([none(n, c.type), c]) for c in columns],
        [x.split()[0] for x in PACKED.split(", ")],
    )


def emit_anchors(batches: Iterator[pa.RecordBatch], n_parts: int) -> Iterator[pa.RecordBatch]:
    """Blobs of anchors by part, and the rows of this task that are settled already, spread over the parts."""

    def out(held: list[np.ndarray]) -> pa.RecordBatch:
        first, covered = settle(np.concatenate(held))
        part = (first["hash"] >> np.uint64(40)).astype(np.int64) % n_parts
        order = np.argsort(part, kind="stable")
        first, part = first[order], part[order]
        cuts = np.nonzero(np.r_[True, part[1:] != part[:-1]])[0]
        # Column after column: equal high bytes compress well.
        blobs = [b"".join(np.ascontiguousarray(first[name][a:b]).tobytes() for name in ANCHOR.names) for a, b in zip(cuts, np.r_[cuts[1:], len(first)], strict=True)]
        return packed(part[cuts], blobs, covered, n_parts)

    held: list[np.ndarray] = []
    n = 0
    for batch in batches:
        some: list[tuple[int, int, bytes]] = []
        size = 0
        for doc, body, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if len(text) > BUFFER:
                held += list(text_anchors(doc, body, text))
                n += len(held[-1])
                continue
            some.append((doc, body, text))
            size += len(text)
            if size > BUFFER:
                held.append(anchors(some))
                n += len(held[-1])
                some, size = [], 0
        held.append(anchors(some))
        n += len(held[-1])
        if n > HELD:
            yield out(held)
            held, n = [], 0
    if n:
        yield out(held)


def unpacked(blob: bytes) -> np.ndarray:
    n = len(blob) // ANCHOR.itemsize
    out, at = np.zeros(n, ANCHOR), 0
    for name in ANCHOR.names:
        size = ANCHOR[name].itemsize * n
        out[name] = np.frombuffer(blob[at : at + size], ANCHOR[name])
        at += size
    return out


WANTED = "doc long, body long, spots binary, wanted binary"


def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each part: rows covered as a whole, and the first rows of contexts whose anchor has several.

    wanted holds place, anchor and hot mark of the latter, packed by document.
    """
    want = np.dtype([("at", "<u4"), ("hash", "<u8"), ("hot", "u1")])

    def out(held: list[bytes]) -> pa.RecordBatch:
        first, covered = settle(np.concatenate([unpacked(x) for x in held]))
        new = np.r_[True, (first["hash"][1:] != first["hash"][:-1]) | (first["context"][1:] != first["context"][:-1])] if len(first) else np.zeros(0, bool)
        one = first[new]
        group = np.r_[True, one["hash"][1:] != one["hash"][:-1]] if len(one) else np.zeros(0, bool)
        starts = np.nonzero(group)[0]
        count = np.diff(np.r_[starts, len(one)])
        docs = (np.minimum.reduceat(one["doc"], starts) != np.maximum.reduceat(one["doc"], starts)) if len(one) else np.zeros(0, bool)
        several = (docs & (count > 1))[np.cumsum(group) - 1]
        hot = (count > HOT_CONTEXTS)[np.cumsum(group) - 1]
        # All first rows of a wanted context, one for each place in the document of that context.
        index = np.cumsum(new) - 1
        rows, mark = first[several[index]], hot[index][several[index]]
        order = np.lexsort((rows["at"], rows["body"], rows["doc"]))
        rows, mark = rows[order], mark[order]
        wanted = np.zeros(len(rows), want)
        wanted["at"], wanted["hash"], wanted["hot"] = rows["at"], rows["hash"], mark
        cuts = np.nonzero(np.r_[True, (rows["doc"][1:] != rows["doc"][:-1]) | (rows["body"][1:] != rows["body"][:-1])])[0] if len(rows) else np.zeros(0, int)
        ends = np.r_[cuts[1:], len(rows)] if len(rows) else cuts
        columns, _ = spots(covered)
        m, k = len(columns[0]), len(cuts)
        return pa.RecordBatch.from_arrays(
            [
                pa.concat_arrays([columns[0], pa.array(rows["doc"][cuts])]),
                pa.concat_arrays([columns[1], pa.array(rows["body"][cuts])]),
                pa.concat_arrays([columns[2], pa.nulls(k, pa.binary())]),
                pa.concat_arrays([pa.nulls(m, pa.binary()), pa.array([wanted[a:b].tobytes() for a, b in zip(cuts, ends, strict=True)], pa.binary())]),
            ],
            ["doc", "body", "spots", "wanted"],
        )

    held: list[bytes] = []
    last = None
    for batch in batches:
        for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if part != last and held:
                yield out(held)
                held = []
            last = part
            held.append(blob)
    if held:
        yield out(held)


def cut_contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bytes of wanted contexts: hash, hot, doc, body, at (the context's start in the text), lead (the anchor's place in it) and context."""
    want = np.dtype([("at", "<u4"), ("hash", "<u8"), ("hot", "u1")])
    for batch in batches:
        columns: list[list[np.ndarray]] = [[] for _ in range(6)]
        found: list[bytes] = []
        for doc, body, blob, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            w = np.frombuffer(blob, want)
            at = w["at"].astype(np.int64)
            lo = np.maximum(at - BACK, 0)
            for column, x in zip(columns, (w["hash"].astype(np.uint64).view(np.int64), w["hot"].astype(bool), np.full(len(w), doc), np.full(len(w), body), lo, at - lo), strict=True):
                column.append(x)
            found += [text[a:b] for a, b in zip(lo.tolist(), (at + SPAN).tolist(), strict=True)]
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in columns] + [pa.array(found, pa.binary())], ["hash", "hot", "doc", "body", "at", "lead", "context"])


def lyndon_suffix_array(text: list[int]) -> list[int]:
    """The starts of the suffixes of text in ascending order.

    Suffixes lie in groups, kept in a linked list in ascending order; at first by
    their first character. The highest group that was not processed yet has its
    final prefix u, a Lyndon word. The previous smaller suffix of each member gets
    u appended to its prefix, as often as members name it, and so moves to a new
    group just above its old one. When all are processed, each group holds the
    suffixes of one Lyndon prefix, and one ascending pass along the pointers puts
    them in order.
    """
    n = len(text)
    ids = {c: k for k, c in enumerate(sorted(set(text)))}
    group = [ids[c] for c in text]
    members: list[list[int]] = [[] for _ in ids]
    for s, g in enumerate(group):
        members[g].append(s)
    below, above = list(range(-1, len(ids) - 1)), list(range(1, len(ids) + 1))
    previous, done = [-1] * n, [False] * n
    descending: list[int] = []
    g = len(ids) - 1
    while g >= 0:
        own = [s for s in members[g] if group[s] == g]
        members[g] = own
        if len(own) == 1:  # most groups: no member can name the same suffix twice
            s = own[0]
            p = s - 1
            while p >= 0 and done[p]:
                p = previous[p]
            previous[s] = p
            done[s] = True
            descending.append(g)
            if p >= 0:
                old, new = group[p], len(members)
                group[p] = new
                members.append([p])
                below.append(old)
                above.append(above[old])
                below[above[old]] = new
                above[old] = new
        elif own:
            own.sort()
            descending.append(g)
            named: dict[int, int] = {}
            for s in own:
                p = s - 1
                while p >= 0 and done[p]:
                    p = previous[p]
                if p >= 0 and group[p] == g:
                    p = previous[p]  # the same prefix stands before: both have the same smaller suffix
                previous[s] = p
                if p >= 0:
                    named[p] = named.get(p, 0) + 1
            for s in own:
                done[s] = True
            moved: dict[tuple[int, int], list[int]] = {}
            for p, times in named.items():
                moved.setdefault((-times, group[p]), []).append(p)
            for _, old in sorted(moved):  # fewer times come later and so lie nearer to the old group
                new = len(members)
                members.append(moved[_, old])
                for p in members[new]:
                    group[p] = new
                below.append(old)
                above.append(above[old])
                below[above[old]] = new
                above[old] = new
        g = below[g]
    start = [0] * len(members)
    total = 0
    for g in reversed(descending):
        start[g] = total
        total += len(members[g])
    order, placed = [-1] * n, [False] * n
    for i in range(-1, n - 1):
        s = n - 1 if i < 0 else order[i] - 1
        while s >= 0 and not placed[s]:
            g = group[s]
            order[start[g]] = s
            start[g] += 1
            placed[s] = True
            s = previous[s]
    return order


def common(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n]) ^ int.from_bytes(b[:n])
    return n - (x.bit_length() + 7) // 8


def reach(parts: list[bytes]) -> list[int]:
    """The longest prefix that each of some strings has in common with any other."""
    order = sorted(range(len(parts)), key=parts.__getitem__)
    out = [0] * len(parts)
    for i, j in zip(order, order[1:], strict=False):
        k = common(parts[i], parts[j])
        out[i], out[j] = max(out[i], k), max(out[j], k)
    return out


def trimmed(leads: list[int], contexts: list[bytes]) -> list[tuple[int, int]]:
    """The stretch of each context of one anchor beyond which it agrees with no other; empty below SPAN bytes."""
    right = reach([c[k:] for k, c in zip(leads, contexts, strict=True)])
    left = reach([c[:k][::-1] for k, c in zip(leads, contexts, strict=True)])
    return [(k - a, k + b) if a + b >= SPAN else (0, 0) for k, a, b in zip(leads, left, right, strict=True)]


def covered_stretches(stretches: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, start) of the SPAN-byte strings that also start in a stretch of a smaller doc."""
    lengths = np.array([len(x) for x in stretches])
    codes = np.zeros(int(lengths.sum()) + len(lengths), np.int64)  # a zero ends each stretch
    starts = np.cumsum(np.r_[0, lengths[:-1] + 1])
    for k, x in zip(starts, stretches, strict=True):
        codes[k : k + len(x)] = np.frombuffer(x, np.uint8)
    inside = np.ones(len(codes), bool)
    inside[np.r_[starts[1:], len(codes)] - 1] = False
    codes[inside] += 1
    order = np.array(lyndon_suffix_array(codes.tolist()))
    owner = np.searchsorted(starts, order, side="right") - 1
    full = order + SPAN <= starts[owner] + lengths[owner]
    order, owner = order[full], owner[full]
    view = np.lib.stride_tricks.sliding_window_view(codes.astype(np.int16), SPAN)
    differ = np.ones(len(order), bool)
    for at in range(1, len(order), 50_000):
        hi = min(at + 50_000, len(order))
        differ[at:hi] = (view[order[at:hi]] != view[order[at - 1 : hi - 1]]).any(axis=1)
    runs = np.nonzero(differ)[0]
    least = np.minimum.reduceat(docs[owner], runs)[np.cumsum(differ) - 1]
    hit = least < docs[owner]
    return owner[hit], (order - starts[owner])[hit]


SPANS = "doc long, body long, start long, stop long"


def intervals(doc: np.ndarray, body: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Covered strings as intervals, those that follow each other without a gap as one."""
    order = np.lexsort((start, body, doc))
    doc, body, start = doc[order], body[order], start[order]
    new = np.nonzero(np.r_[True, (doc[1:] != doc[:-1]) | (body[1:] != body[:-1]) | (start[1:] > start[:-1] + 1)])[0] if len(doc) else np.zeros(0, int)
    last = np.r_[new[1:], len(doc)] - 1 if len(doc) else new
    return pa.RecordBatch.from_arrays([pa.array(doc[new]), pa.array(body[new]), pa.array(start[new]), pa.array(start[last] + SPAN)], ["doc", "body", "start", "stop"])


def sort_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Intervals covered by smaller documents, of contexts that arrive anchor by anchor."""
    rows: list[tuple[int, int, int, bytes]] = []  # doc, body, start, stretch: of equal stretches the smallest doc's
    whole: list[tuple[int, int, int, int]] = []  # doc, body, start, stop of the others, which lie in that one
    size = 0
    group: list[tuple] = []
    last = None

    def close() -> None:
        nonlocal size
        same: dict[bytes, list[tuple[int, int, int]]] = {}
        for (_, doc, body, at, _, context), (a, b) in zip(group, trimmed([x[4] for x in group], [x[5] for x in group]), strict=True):
            if b:
                same.setdefault(context[a:b], []).append((doc, body, at + a))
        for stretch, places in same.items():
            least = min(places)[0]
            whole.extend((doc, body, at, at + len(stretch)) for doc, body, at in places if doc > least)
            if len(same) > 1:
                rows.extend((doc, body, at, stretch) for doc, body, at in places if doc == least)
                size += sum(len(stretch) + 1 for doc, _, _ in places if doc == least)
        group.clear()

    def out() -> Iterator[pa.RecordBatch]:
        if whole:
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in whole], pa.int64()) for k in range(4)], ["doc", "body", "start", "stop"])
        if rows:
            doc, body, at = (np.array([x[k] for x in rows], np.int64) for k in range(3))
            row, start = covered_stretches([x[3] for x in rows], doc)
            yield intervals(doc[row], body[row], at[row] + start)
        whole.clear()
        rows.clear()

    for batch in batches:
        for x in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if x[0] != last and group:
                close()
                if size > SORT_CHARS or len(whole) > 200_000:
                    yield from out()
                    size = 0
            last = x[0]
            group.append(x)
    if group:
        close()
    yield from out()


def hot_intervals(rows: DataFrame) -> DataFrame:
    """The same for anchors of very many contexts: one aggregation over all their strings."""
    places = F.sequence(F.lit(0), F.octet_length("context") - SPAN)
    strings = rows.select("doc", "body", "at", F.posexplode(F.transform(places, lambda k: F.substring("context", k + 1, SPAN))).alias("k", "s"))
    least = strings.groupBy("s").agg(F.min("doc").alias("least"), F.max("doc").alias("most")).where("least < most")
    hit = strings.join(least, "s").where("doc > least")
    return hit.select("doc", "body", (F.col("at") + F.col("k")).alias("start"), (F.col("at") + F.col("k") + SPAN).alias("stop"))


def keyed(docs: DataFrame) -> DataFrame:
    return docs.withColumns({"_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(NOBODY)), "_body": F.xxhash64("text"), "_bytes": F.encode(F.coalesce("text", F.lit("")), "UTF-8")})


def covered(docs: DataFrame) -> DataFrame:
    """doc, body, spots (anchors whose whole context is covered) and spans (covered intervals) of documents that lose bytes."""
    texts = keyed(docs).select(F.col("_doc").alias("doc"), F.col("_body").alias("body"), F.col("_bytes").alias("text")).where(F.octet_length("text") >= SPAN)
    n_parts = parts_for(texts.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0])
    found = stored(texts.mapInArrow(lambda it: emit_anchors(it, n_parts), PACKED).repartition("part").sortWithinPartitions("part").mapInArrow(split_parts, WANTED), "anchors")
    wanted = found.where("wanted IS NOT NULL").groupBy("doc", "body").agg(F.collect_list("wanted").alias("list"))
    blob = F.aggregate("list", F.lit(bytearray()), lambda a, x: F.concat(a, x))
    contexts = wanted.select("doc", "body", blob.alias("wanted")).join(texts, ["doc", "body"]).select("doc", "body", "wanted", "text")
    cut = stored(contexts.mapInArrow(cut_contexts, "hash long, hot boolean, doc long, body long, at long, lead long, context binary"), "contexts")
    cold = cut.where("NOT hot").select("hash", "doc", "body", "at", "lead", "context").repartition("hash").sortWithinPartitions("hash").mapInArrow(sort_groups, SPANS)
    spans = stored(cold.union(hot_intervals(cut.where("hot"))), "spans")
    whole = found.where("spots IS NOT NULL").select("doc", "body", "spots", F.lit(None).cast("struct<start:bigint,stop:bigint>").alias("span"))
    rest = spans.select("doc", "body", F.lit(None).cast("binary").alias("spots"), F.struct("start", "stop").alias("span"))
    return whole.union(rest).groupBy("doc", "body").agg(F.collect_list("spots").alias("spots"), F.collect_list("span").alias("spans"))


def split_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pass rows that were settled before the shuffle on, and let the anchors of each part meet."""

    def blobs() -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ready = pc.is_null(batch.column(1))
            early = batch.filter(ready)
            if early.num_rows:
                held.append(pa.RecordBatch.from_arrays([early.column(2), early.column(3), early.column(4), pa.nulls(early.num_rows, pa.binary())], ["doc", "body", "spots", "wanted"]))
            late = batch.filter(pc.invert(ready))
            if late.num_rows:
                yield late

    held: list[pa.RecordBatch] = []
    for batch in meet(blobs()):
        yield from held
        held.clear()
        yield batch
    yield from held


def kept_bytes(text: bytes, spots: list[bytes], spans: list[tuple[int, int]]) -> tuple[bytes, int, int]:
    """What is left of a text, the number of bytes removed and of maximal removed runs."""
    edge = np.zeros(len(text) + 1, np.int64)
    if spots:
        at = np.frombuffer(b"".join(spots), "<u4").astype(np.int64)
        edge += np.bincount(np.maximum(at - BACK, 0), minlength=len(edge)) - np.bincount(np.minimum(at + SPAN, len(text)), minlength=len(edge))
    for start, stop in spans:
        edge[start] += 1
        edge[stop] -= 1
    gone = np.cumsum(edge[:-1]) > 0
    runs = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(gone) else 0
    return np.frombuffer(text, np.uint8)[~gone].tobytes(), int(gone.sum()), runs


def remove(docs: DataFrame) -> DataFrame:
    """docs with n_bytes, n_removed, n_spans and kept (the remaining bytes) beside its columns."""
    shared_dir(docs.sparkSession)
    found = stored(covered(docs.select("doc_id", "text")), "covered").withColumnsRenamed({"doc": "_doc", "body": "_body", "spots": "_spots", "spans": "_spans"})
    packed, columns = set_aside(docs, ("doc_id", "text"), RESULTS)
    joined = keyed(packed).join(found, ["_doc", "_body"], "left")

    @F.pandas_udf("n_bytes long, n_removed long, n_spans long, kept binary")
    def cut(text: pd.Series, spots: pd.Series, spans: pd.Series) -> pd.DataFrame:
        rows = []
        for t, a, b in zip(text, spots, spans, strict=True):
            kept, gone, runs = kept_bytes(t, list(a), [(x["start"], x["stop"]) for x in b]) if a is not None else (t, 0, 0)
            rows.append((len(t), gone, runs, bytes(kept)))
        return pd.DataFrame(rows, columns=list(RESULTS))

    return joined.withColumn("_out", cut("_bytes", "_spots", "_spans")).select(*columns, "_out.*")
