r"""Substring dedup: De Bruijn compaction of token k-mers (operator 7).

Words are ``[^\x20\x09-\x0D]+``.  Every window of ``k`` words is an edge of the De
Bruijn graph from the node of its first k-1 words to that of its last k-1; an edge is
told by its two nodes' hashes, 128 bits together.  A document's word goes when it lies in
an edge that also occurs in a document with a smaller id.

0. *Copies.* A document whose whole text a smaller document has loses all its words
   (if they make one window) and leaves the graph to that document.
1. *Sampling.* Each edge holds k-4 five-word shingles; the one with the smallest
   hash is its anchor, so equal edges have equal anchors, and neighbouring edges
   mostly share one.  Only about every fifth word is an anchor.  Anchors that
   occur in one document alone cannot belong to a repeated edge.
2. *Edges.* Documents that hold repeated anchors give the edges under these
   anchors.  Each occurrence is matched with its source: a document and word index, in
   the smallest document of its batch and, for what the batches leave, of all.
3. *Paths.* Consecutive edges of a document whose sources are consecutive words of one
   document form a path, which has a source coordinate and a length.
4. *Verification.* A path whose source is in its own batch is held against it word by
   word there.  Other paths meet their source's text at the source coordinate (a join
   on the source document), and the digest of the words that stand there must equal
   that of the path's own words.  A difference, which only equal hashes of different
   words can bring about, ends the run; another ``seed`` then gives other hashes.

``unitigs`` compacts the graph of all repeated edges: nodes' degrees are aggregates,
branching nodes cut the runs of their source documents by a join, and runs that meet in
a node that does not branch are put together by pointer-jumping joins.  Which words go
depends on edges alone, so the query does not wait for them.

Batches combine before they shuffle: of an anchor's or edge's occurrences in one
Arrow batch only the smallest document's go to the exchange, the others as paths
behind it.  A passage in a third of all documents thus sends a row per batch and edge,
and a path per document; sorted rows are read as a stream with one source in memory.
Per document only its own anchors and paths are gathered.

Defined cases: a null text has no words; a document without an id counts as larger
than every id and is never a source (nor are ids from 2**63 - 2**40 on); rows with one
id are not "smaller" than each other, and each is judged by its own words; an empty
table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import words as W
from .common import by_batch, clear, partitions, text_hashes, whole_copies, written

ANCHOR = 5
#: From here on, documents without an id, told apart by their texts.
NO_ID = (1 << 63) - (1 << 40)
#: Words of a source whose requests are looked up together.
STRETCH = 256
U64 = np.uint64
#: What a batch shows of an anchor's row: its only document, the smallest of several, one of the others.
ONE, MANY, KNOWN = 0, 1, 2


def _texts(batch: pa.RecordBatch, column: int):
    """Slices of a batch's texts as (first row, last row, words)."""
    data, offsets = W.text_buffers(batch.column(column))
    for a, z in W.slices(offsets):
        yield a, z, W.Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])


def _joined(parts: list[tuple[np.ndarray, ...]], kinds: list) -> list[np.ndarray]:
    return [np.concatenate(x) if parts else np.empty(0, kind) for x, kind in zip(zip(*parts) if parts else kinds, kinds)]


def _starts(*keys: np.ndarray) -> np.ndarray:
    """Mask of the rows that begin a run of equal keys."""
    new = np.zeros(len(keys[0]), bool)
    if len(new):
        new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return new


def _anchors(k: int, seed: int = 0):
    """Anchors of a batch's documents.  An anchor's smallest document gives a row with
    ``state`` ``MANY`` where the batch has others, else ``ONE``; the others, whose anchor
    is thus known to repeat, give rows ``KNOWN``.  Both come from one pass, since a
    second one may see other batches."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        parts = []
        for a, z, words in _texts(batch, 1):
            at = np.flatnonzero(W.whole(words.first, k))
            if len(at):
                five = min(ANCHOR, k)
                shingle = W.rolling(words.hashes(seed=seed), five)
                least = W.minimizers(shingle, k - five + 1)[at]
                least = least[_starts(least)]
                parts.append((shingle[least], ids[a:z][words.row_of()[least]]))
        anchor, doc = _joined(parts, [U64, np.int64])
        order = np.lexsort((doc, anchor))
        anchor, doc = anchor[order], doc[order]
        once = _starts(anchor, doc)
        anchor, doc = anchor[once], doc[once]
        first = _starts(anchor)
        state = np.where(first, ONE, KNOWN).astype(np.int8)
        state[:-1][first[:-1] & ~first[1:]] = MANY
        return pa.record_batch([pa.array(anchor.view(np.int64)), pa.array(doc), pa.array(state)], names=["anchor", "doc", "state"])

    return by_batch(run)


def _repeated(batches):
    """Rows sorted by anchor and document -> those whose anchor has two documents.

    A stream: of the anchor being read, at most one row is held back.  ``KNOWN`` rows
    pass; they need not be with their anchor."""
    held = None  # (anchor, document, known to repeat)
    for batch in batches:
        anchor, doc, state = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
        ready = state == KNOWN
        if ready.any():
            yield pa.record_batch([pa.array(doc[ready]), pa.array(anchor[ready])], names=["doc", "anchor"])
        anchor, doc, many = anchor[~ready], doc[~ready], state[~ready] == MANY
        if not len(anchor):
            continue
        if held is not None:
            anchor, doc, many = np.append(held[0], anchor), np.append(held[1], doc), np.append(held[2], many)
        head = np.flatnonzero(_starts(anchor))
        group = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(anchor))))
        known = np.logical_or.reduceat(many, head)
        known[group[doc != doc[head][group]]] = True
        emit = known[group]
        if held is not None and held[2]:
            emit[0] = False  # given out before
        yield pa.record_batch([pa.array(doc[emit]), pa.array(anchor[emit])], names=["doc", "anchor"])
        held = (anchor[-1], doc[head[-1]], bool(known[-1]))


def _nodes(hashes: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The node that each window of ``k`` words leaves, and the one it enters."""
    if k == 1:
        return hashes, W.mix(hashes ^ U64(0xA5A5A5A55A5A5A5A))
    nodes = W.rolling(hashes, k - 1)
    return nodes[:-1], nodes[1:]


#: ``seen``: both ends were in one batch, and were held against each other.
ROW = ["doc", "place", "edges", "source", "at", "seen"]


def _runs(doc, place, source, at, *rest) -> list[np.ndarray]:
    """Occurrences and their sources, one edge each -> runs of both, with lengths; in a
    run the arrays of ``rest`` have one value."""
    order = np.lexsort((place, doc))
    doc, place, source, at, *rest = (x[order] for x in (doc, place, source, at, *rest))
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + 1) | (source[1:] != source[:-1]) | (at[1:] != at[:-1] + 1)
    for x in rest:
        new[1:] |= x[1:] != x[:-1]
    head = np.flatnonzero(new)
    return [doc[head], place[head], np.diff(np.append(head, len(doc))), source[head], at[head], *(x[head] for x in rest)]


class _Spoken:
    """A batch's words as bytes: what stands at a word index of a row."""

    def __init__(self):
        self.held = []  # (first row, bytes, places of the words, rows' first words)

    def add(self, row: int, words: W.Words) -> None:
        data, at = words.joined()
        self.held.append((row, data.tobytes(), at, words.first))

    def refuse_unlike(self, row, place, n, source, at) -> None:
        """The runs of ``n`` words must say the same at both ends."""
        starts = np.array([h[0] for h in self.held])
        ends = []
        for rows, places in ((row, place), (source, at)):
            which = np.searchsorted(starts, rows, side="right") - 1
            word = np.array([self.held[w][3][r - self.held[w][0]] for w, r in zip(which.tolist(), rows.tolist())], np.int64) + (places & 0xFFFFFFFF)
            ends.append((which.tolist(), word.tolist()))
        for w, f, v, g, size in zip(*ends[0], *ends[1], n.tolist()):
            a, b = self.held[w], self.held[v]
            if a[1][a[2][f] : a[2][f + size] - 1] != b[1][b[2][g] : b[2][g + size] - 1]:
                raise ValueError(UNLIKE)


UNLIKE = "different words have equal hashes; run again with another seed"


def _edges(k: int, seed: int = 0):
    """Edges under the repeated anchors that came with each document.

    ``place`` packs 30 bits of the text's hash and the word index.  An edge's first
    occurrence in the batch goes on, with ``edges`` -1 where the batch has others, else
    0; the others become runs (``edges`` > 0) behind it, ``source`` and ``at`` being
    its document and place, and have its words.  A run behind the document itself says
    that its edges are like those at ``at``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        part = batch.column(2).to_numpy(zero_copy_only=False)
        hits = batch.column(3)
        found = hits.values.to_numpy(zero_copy_only=False).view(U64)
        ends = hits.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        pieces, spoken = [], _Spoken()
        for a, z, words in _texts(batch, 1):
            at = np.flatnonzero(W.whole(words.first, k))
            # The slice's anchors together: an edge let through by another
            # document's anchor finds no second holder later on.
            known = np.unique(found[ends[a] : ends[z]])
            if not len(at) or not len(known):
                continue
            hashes = words.hashes(seed=seed)
            five = min(ANCHOR, k)
            shingle = W.rolling(hashes, five)
            anchor = shingle[W.minimizers(shingle, k - five + 1)[at]]
            at = at[known[np.minimum(np.searchsorted(known, anchor), len(known) - 1)] == anchor]
            row = words.row_of()[at]
            leaves, enters = _nodes(hashes, k)
            pieces.append((leaves[at], enters[at], ids[a:z][row], part[a:z][row] << 32 | (at - words.first[row]), row + a))
            spoken.add(a, words)
        leaves, enters, doc, place, row = _joined(pieces, [U64, U64, np.int64, np.int64, np.int64])
        order = np.lexsort((place, doc, enters, leaves))
        leaves, enters, doc, place, row = leaves[order], enters[order], doc[order], place[order], row[order]
        head = np.flatnonzero(_starts(leaves, enters))
        origin = np.repeat(head, np.diff(np.append(head, len(leaves))))
        later = (doc != doc[origin]) & (doc[origin] < NO_ID)
        again = (doc == doc[origin]) & (place >> 32 == place[origin] >> 32) & (np.arange(len(doc)) != origin)
        done = later | again
        many = np.zeros(len(doc), np.int64)
        many[origin[later]] = -1
        *runs, own_row, its_row = _runs(doc[done], place[done], doc[origin[done]], place[origin[done]], row[done], row[origin[done]])
        spoken.refuse_unlike(own_row, runs[1], runs[2] + k - 1, its_row, runs[4])
        own, n = ~done, int((~done).sum())
        # Runs need no edge: a few bits of their place spread them over the tasks.
        spread = W.mix(runs[1].view(U64) + runs[0].view(U64)) >> U64(52)
        left, right = np.concatenate([leaves[own], spread]), np.concatenate([enters[own], np.zeros(len(spread), U64)])
        none = np.arange(n + len(spread)) < n
        columns = [pa.array(left.view(np.int64)), pa.array(right.view(np.int64)), pa.array(np.concatenate([doc[own], runs[0]])), pa.array(np.concatenate([place[own], runs[1]]))]
        columns.append(pa.array(np.concatenate([many[own], runs[2]]).astype(np.int32)))
        columns += [pa.array(np.concatenate([np.zeros(n, np.int64), x]), mask=none) for x in runs[3:]]
        return pa.record_batch(columns, names=["leaves", "enters", *ROW[:-1]])

    return by_batch(run)


def _matched(graph: bool):
    """Rows sorted by edge, document and place -> runs, and each occurrence behind its
    source; with ``graph``, also a row without a source for each repeated edge, at its
    first occurrence of all."""

    def run(batches):
        held = None  # (leaves, enters, source document, its place, known to repeat)
        for batch in batches:
            if not batch.num_rows:
                continue
            edges = batch.column(4).to_numpy(zero_copy_only=False)
            ready = batch.filter(pa.array(edges > 0))
            yield pa.record_batch([*(ready.column(i) for i in range(2, 7)), pa.array(np.ones(ready.num_rows, bool))], names=ROW)
            left, right, doc, place = (batch.column(i).to_numpy(zero_copy_only=False)[edges <= 0] for i in range(4))
            many = edges[edges <= 0] < 0
            if not len(left):
                continue
            if held is not None:
                left, right, doc, place, many = (np.append(h, x) for h, x in zip(held, (left, right, doc, place, many)))
            head = np.flatnonzero(_starts(left, right))
            origin = np.repeat(head, np.diff(np.append(head, len(left))))
            later = (doc != doc[origin]) & (doc[origin] < NO_ID)
            n = int(later.sum())
            yield pa.record_batch([pa.array(doc[later]), pa.array(place[later]), pa.array(np.ones(n, np.int32)), pa.array(doc[origin[later]]), pa.array(place[origin[later]]), pa.array(np.zeros(n, bool))], names=ROW)
            known = np.logical_or.reduceat(many | later, head)
            if graph:
                new = known.copy()
                if held is not None and held[4]:
                    new[0] = False  # given out before
                at = head[new]
                none = pa.nulls(len(at), pa.int64())
                yield pa.record_batch([pa.array(doc[at]), pa.array(place[at]), pa.array(np.zeros(len(at), np.int32)), none, none, pa.array(np.zeros(len(at), bool))], names=ROW)
            last = head[-1]
            held = (left[last], right[last], doc[last], place[last], bool(known[-1]))

    return run


def _compact(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A document's runs in one row -> its paths: those seen, and those still to see."""
    occ = batch.column(1)
    ends = occ.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    held = occ.values.slice(ends[0], ends[-1] - ends[0])
    place, size, source, at, seen = (held.field(i).to_numpy(zero_copy_only=False) for i in range(5))
    ids = batch.column(0).to_numpy()
    doc = np.repeat(np.arange(len(ids)), np.diff(ends))
    step = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
    doc, source, seen, place, at = np.repeat(doc, size), np.repeat(source, size), np.repeat(seen, size), np.repeat(place, size) + step, np.repeat(at, size) + step
    like = source == ids[doc]
    order = np.lexsort((like, place, doc))
    doc, place, source, at, seen, like = (x[order] for x in (doc, place, source, at, seen, like))
    # An occurrence that is like another goes with it: where that one has a source.
    plain = np.flatnonzero(~like)
    if like.any() and len(plain):
        keys, wanted = np.rec.fromarrays([doc[plain], place[plain]]), np.rec.fromarrays([doc[like], at[like]])
        found = np.minimum(np.searchsorted(keys, wanted), len(plain) - 1)
        hit = keys[found] == wanted
        named = np.flatnonzero(like)[hit]
        for x in (source, at, seen):
            x[named] = x[plain[found[hit]]]
    keep = np.flatnonzero(source != ids[doc])
    keep = keep[np.lexsort((place[keep], doc[keep]))]
    keep = keep[_starts(doc[keep], place[keep])]  # repeated rows of a table give repeated places
    doc, place, size, source, at, seen = _runs(doc[keep], place[keep], source[keep], at[keep], seen[keep])
    lists = []
    for mask in (seen.astype(bool), ~seen.astype(bool)):
        bounds = np.concatenate([[0], np.cumsum(np.bincount(doc[mask], minlength=len(ids)))]).astype(np.int32)
        kinds = zip(("place", "edges", "source", "at"), (place, size.astype(np.int32), source, at))
        fields = {name: pa.array(x[mask]) for name, x in kinds}
        lists.append(pa.ListArray.from_arrays(pa.array(bounds), pa.StructArray.from_arrays(list(fields.values()), names=list(fields))))
    return pa.record_batch([batch.column(0), *lists], names=["doc", "seen", "open"])


def _digest(data: np.ndarray, at: np.ndarray, first: int, n: int) -> bytes:
    """Of ``n`` words from ``first`` on, one space between them."""
    return hashlib.blake2b(data[at[first] : at[first + n] - 1], digest_size=16).digest()


def _at_source(k: int):
    """(text, part, source, requests (place, edges), stretch) -> ``source, at, edges,
    digest`` of the words that stand there; of a table's repeated rows the first answers."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        order = np.lexsort([batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 4, 2)])
        first = _starts(*(batch.column(i).to_numpy(zero_copy_only=False)[order] for i in (2, 4, 1)))
        batch = batch.take(pa.array(order[first]))
        part, source = (batch.column(i).to_numpy(zero_copy_only=False) for i in (1, 2))
        asked, out = batch.column(3), []
        ends = asked.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        place, edges = (asked.values.field(i).to_numpy(zero_copy_only=False) for i in range(2))
        for a, z, words in _texts(batch, 0):
            data, at = words.joined()
            row = np.repeat(np.arange(a, z), np.diff(ends[a : z + 1]))
            mine = np.flatnonzero(place[ends[a] : ends[z]] >> 32 == part[row])
            row, spot, size = row[mine], place[ends[a] : ends[z]][mine], edges[ends[a] : ends[z]][mine]
            first = words.first[row - a] + (spot & 0xFFFFFFFF)
            digests = [_digest(data, at, f, n + k - 1) for f, n in zip(first.tolist(), size.tolist())]
            out.append(pa.record_batch([pa.array(source[row]), pa.array(spot), pa.array(size.astype(np.int32)), pa.array(digests, pa.binary())], names=["source", "at", "edges", "digest"]))
        return out

    return by_batch(run)


def _keep(k: int, plain: bool):
    """Each text's kept words; without ``plain`` an untouched text stays as it was.
    Paths whose source has other words end the run."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        data, offsets = W.text_buffers(batch.column(1))
        own = batch.column(2).to_numpy(zero_copy_only=False)
        copy = batch.column(4).to_numpy(zero_copy_only=False)
        ends = batch.column(3).offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        place_all, length_all = (batch.column(3).values.field(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        digests = batch.column(3).values.field(2)
        out = []
        for a, z in W.slices(offsets, 1 << 20):
            words = W.Words(data[offsets[a] : offsets[z]], offsets[a : z + 1] - offsets[a])
            rows, n = z - a, len(words)
            path_row = np.repeat(np.arange(rows), np.diff(ends[a : z + 1]))
            places = place_all[ends[a] : ends[z]]
            mine = places >> 32 == own[a:z][path_row]  # rows of one id may differ in text
            s = (words.first[path_row] + (places & 0xFFFFFFFF))[mine]
            e = s + length_all[ends[a] : ends[z]][mine] + (k - 1)
            joined, at = words.joined()
            for i, f, t in zip((ends[a] + np.flatnonzero(mine)).tolist(), s.tolist(), e.tolist()):
                if digests[i].is_valid and digests[i].as_py() != _digest(joined, at, f, t - f):
                    raise ValueError(UNLIKE)
            cover = np.zeros(n + 1, np.int64)
            np.add.at(cover, s, 1)
            np.add.at(cover, e, -1)
            n_words = np.diff(words.first)
            kept = (np.cumsum(cover[:n]) == 0) & ~np.repeat(copy[a:z] & (n_words >= k), n_words)
            total = np.concatenate([[0], np.cumsum(kept)])
            n_kept = total[words.first[1:]] - total[words.first[:-1]]
            # Kept words one after the other, a space after each but a row's last.
            first_kept = total[words.first]
            size = np.diff(at)[kept]
            stop = np.concatenate([[0], np.cumsum(size)])
            drop = np.repeat(~kept, np.diff(at))
            drop[at[1:][kept][first_kept[1:][n_kept > 0] - 1] - 1] = True
            buffer = joined[~drop]
            text_size = stop[first_kept[1:]] - stop[first_kept[:-1]] - (n_kept > 0)
            text_ends = np.concatenate([[0], np.cumsum(text_size)]).astype(np.int32)
            text = pa.StringArray.from_buffers(rows, pa.py_buffer(text_ends.tobytes()), pa.py_buffer(buffer.tobytes()))
            if not plain:
                text = pc.if_else(pa.array(n_kept == n_words), batch.column(1).slice(a, rows), text)
            columns = [pa.array(n_words.astype(np.int64)), pa.array((n_words - n_kept).astype(np.int64)), text]
            rest = [batch.column(i).slice(a, rows) for i in range(5, batch.num_columns)]
            names = batch.schema.names[5:]
            out.append(pa.record_batch([*rest, *columns], names=[*names, "n_words", "n_removed", "kept_text"]))
        return out

    return by_batch(run)


def _texts_by_id(docs: DataFrame, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """``doc, text, part, copy`` and the carried columns as ``rest``.  Every use joins on ``doc`` from the same
    columns, so that Spark shuffles the texts once and reads that shuffle again."""
    rest = F.struct(*carry) if carry else F.lit(0)
    text = F.col(text_col).cast("string")
    no_id = F.lit(NO_ID) + F.xxhash64(text).bitwiseAND(F.lit((1 << 40) - 1))
    texts = docs.select(F.coalesce(F.col(id_col).cast("long"), no_id).alias("doc"), text.alias("text"), rest.alias("rest"))
    copies = whole_copies(texts.select("doc", *text_hashes()), "doc").groupBy("doc").agg(F.collect_set("h1").alias("copies"))
    whole = F.xxhash64("text")
    joined = texts.join(copies.hint("merge"), "doc", "left")
    return joined.select("doc", "text", "rest", whole.bitwiseAND(F.lit(0x3FFFFFFF)).alias("part"), F.coalesce(F.array_contains("copies", whole), F.lit(False)).alias("copy"))


def _occurrences(texts: DataFrame, k: int, seed: int, graph: bool) -> DataFrame:
    """``doc, place, edges, source, at, seen``: runs of edges behind their sources, and
    with ``graph`` the repeated edges themselves."""
    n = partitions(texts)
    own = texts.where("not copy")
    plain = own.select("doc", "text", "rest")
    anchors = plain.mapInArrow(_anchors(k, seed), "anchor long, doc long, state byte")
    # Rows known to repeat need not meet their anchor's others: they are spread, so that a common anchor fills no task.
    spread = F.when(F.col("state") == KNOWN, F.xxhash64("doc", "anchor")).otherwise(F.col("anchor"))
    met = anchors.repartition(n, spread).sortWithinPartitions("anchor", "doc").mapInArrow(_repeated, "doc long, anchor long")
    hits = met.groupBy("doc").agg(F.collect_list("anchor").alias("hits"))
    kinds = "doc long, place long, edges int, source long, at long"
    edges = own.join(hits.hint("merge"), "doc").select("doc", "text", "part", "hits", "rest").mapInArrow(_edges(k, seed), f"leaves long, enters long, {kinds}")
    rows = edges.repartition(n, "leaves", "enters").sortWithinPartitions("leaves", "enters", "doc", "place")
    return rows.mapInArrow(_matched(graph), f"{kinds}, seen boolean")


PATH = "array<struct<place: long, edges: int, source: long, at: long>>"


def _paths(texts: DataFrame, k: int, seed: int) -> DataFrame:
    """``doc, seen, open``: each document's paths, those held against their source and
    those still to be."""
    found = _occurrences(texts, k, seed, False).groupBy("doc").agg(F.collect_list(F.struct("place", "edges", "source", "at", "seen")).alias("occ"))
    return found.mapInArrow(by_batch(_compact), f"doc long, seen {PATH}, open {PATH}")


def _verified(texts: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """``doc, paths``: lists of paths with ``digest``, that of the words at their source
    coordinate; null for those that were seen.

    Requests are looked up once however many documents make them, and those of one
    stretch of a source together: they are bounded by the source's own length."""
    open_ = paths.select("doc", F.explode("open").alias("p")).select("doc", "p.*")
    stretch = F.floor(F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)) / STRETCH)
    asked = open_.groupBy("source", stretch.alias("stretch")).agg(F.collect_set(F.struct("at", "edges")).alias("asked"))
    # The same columns of ``texts`` as elsewhere, so that its shuffle is read again.
    there = texts.where("not copy").join(asked.withColumnRenamed("source", "doc").hint("merge"), "doc").select("text", "part", "doc", "asked", "stretch", "rest")
    digests = there.mapInArrow(_at_source(k), "source long, at long, edges int, digest binary")
    found = open_.join(digests.hint("merge"), ["source", "at", "edges"]).groupBy("doc").agg(F.collect_list(F.struct("place", "edges", "source", "at", "digest")).alias("paths"))
    none = F.lit(None).cast("binary").alias("digest")
    seen = paths.where("size(seen) > 0").select("doc", F.transform("seen", lambda p: F.struct(p["place"].alias("place"), p["edges"].alias("edges"), p["source"].alias("source"), p["at"].alias("at"), none)).alias("paths"))
    return seen.union(found).groupBy("doc").agg(F.flatten(F.collect_list("paths")).alias("paths"))


def repeated_paths(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, seed: int = 0) -> DataFrame:
    """Each document's paths, whole copies aside: ``doc``, ``part`` (30 bits of the
    text's hash), ``start`` (word index), ``edges`` (windows in the path), ``source`` (a
    smaller document with these windows), ``source_start`` (their word index there) and
    ``digest`` (of the source's words; null where both were compared as they stand)."""
    texts = _texts_by_id(docs, id_col, text_col, [])
    found = _verified(texts, _paths(texts, k, seed), k).select("doc", F.explode("paths").alias("p")).select("doc", "p.*")
    index = F.lit(0xFFFFFFFF)
    return found.select("doc", F.shiftright("place", 32).alias("part"), F.col("place").bitwiseAND(index).alias("start"), "edges", "source", F.col("at").bitwiseAND(index).alias("source_start"), "digest")


def _chains(k: int, seed: int):
    """(text, part, the document's repeated edges) -> its runs of consecutive edges
    (``role`` null, with their length) and their nodes: the first (``role`` 0, left
    only), those inside (1) and the last (2, entered only)."""

    def run(batch: pa.RecordBatch) -> list[pa.RecordBatch]:
        doc, part = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2))
        occ, out = batch.column(3), []
        ends = occ.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
        places = occ.values.to_numpy(zero_copy_only=False)
        for a, z, words in _texts(batch, 1):
            row = np.repeat(np.arange(a, z), np.diff(ends[a : z + 1]))
            place = places[ends[a] : ends[z]]
            mine = place >> 32 == part[row]
            row, place = row[mine], place[mine]
            order = np.lexsort((place, row))
            row, place = row[order], place[order]
            once = _starts(row, place)
            row, place = row[once], place[once]
            leaves, enters = _nodes(words.hashes(seed=seed), k)
            at = words.first[row - a] + (place & 0xFFFFFFFF)
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1] + 1)
            head = np.flatnonzero(new)
            size = np.diff(np.append(head, len(row)))
            chain = np.repeat(place[head], size)
            last = np.append(head[1:], len(row))[: len(head)] - 1
            columns = [
                np.concatenate([doc[row[head]], doc[row], doc[row[last]]]),
                np.concatenate([place[head], chain, chain[last]]),
                np.concatenate([size, place, place[last] + 1]),
                np.concatenate([np.full(len(head), -1), np.where(new, 0, 1), np.full(len(head), 2)]),
                np.concatenate([np.zeros(len(head), U64), leaves[at], enters[at[last]]]).view(np.int64),
            ]
            out.append(pa.record_batch([pa.array(x.astype(np.int64)) for x in columns], names=["doc", "chain", "place", "role", "node"]))
        return out

    return by_batch(run)


def unitigs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, seed: int = 0) -> DataFrame:
    """The compacted graph of all repeated edges, whole copies aside.  A row per
    segment: ``doc``, ``place`` (30 bits of the text's hash and the word index) and
    ``edges`` of a run in an edge's first document, ``unitig_doc`` and ``unitig_place`` of
    the first segment of its nonbranching path, and ``offset``, the edges before it
    there.  A path that closes on itself keeps its segments apart."""
    spark, scratch = docs.sparkSession, []
    texts = _texts_by_id(docs, id_col, text_col, [])
    graph = _occurrences(texts, k, seed, True).where("source is null").groupBy("doc").agg(F.collect_list("place").alias("places"))
    held = texts.where("not copy").join(graph.hint("merge"), "doc").select("doc", "text", "part", "places", "rest")
    walked = written(held.mapInArrow(_chains(k, seed), "doc long, chain long, place long, role long, node long"), "walked", scratch=scratch)
    nodes = walked.where("role >= 0")
    degrees = nodes.groupBy("node").agg(F.count_if(F.col("role") <= 1).alias("outs"), F.count_if(F.col("role") >= 1).alias("ins"))
    # Branching nodes inside a run cut it.
    branching = degrees.where("ins > 1 or outs > 1").select("node")
    cuts = nodes.where("role = 1").join(branching.hint("merge"), "node").groupBy("doc", "chain").agg(F.array_sort(F.collect_set("place")).alias("cuts"))
    runs = walked.where("role = -1").select("doc", "chain", F.col("place").alias("size")).join(cuts.hint("merge"), ["doc", "chain"], "left")
    cut = F.coalesce("cuts", F.array().cast("array<long>"))
    bounds = F.arrays_zip(F.concat(F.array("chain"), cut).alias("place"), F.concat(cut, F.array(F.col("chain") + F.col("size"))).alias("stop"))
    segments = runs.select("doc", "chain", F.explode(bounds).alias("s")).select("doc", "chain", F.col("s.place").alias("place"), (F.col("s.stop") - F.col("s.place")).alias("edges"))
    segments = written(segments, "segments", scratch=scratch)
    # A run's end and another's start in a node that does not branch: one follows the other.
    single = degrees.where("ins = 1 and outs = 1").select("node")
    ends = nodes.where("role = 2").join(single.hint("merge"), "node").select("node", F.col("doc").alias("a_doc"), F.col("chain").alias("a_chain"))
    starts = nodes.where("role = 0").select("node", F.col("doc").alias("b_doc"), F.col("chain").alias("b_chain"))
    last = segments.groupBy(F.col("doc").alias("a_doc"), F.col("chain").alias("a_chain")).agg(F.max(F.struct("place", "edges")).alias("last"))
    jumps = ends.join(starts.hint("merge"), "node").join(last.hint("merge"), ["a_doc", "a_chain"])
    jumps = jumps.select(F.col("b_doc").alias("doc"), F.col("b_chain").alias("place"), F.col("a_doc").alias("to_doc"), F.col("last.place").alias("to_place"), F.col("last.edges").alias("offset"))
    jumps = _jump(written(jumps, "jumps", scratch=scratch), scratch)
    out = segments.join(jumps.hint("merge"), ["doc", "place"], "left")
    out = out.select("doc", "place", "edges", F.coalesce("to_doc", "doc").alias("unitig_doc"), F.coalesce("to_place", "place").alias("unitig_place"), F.coalesce("offset", F.lit(0).cast("long")).alias("offset"))
    out = written(out, "unitigs")
    clear(spark, scratch)
    return out


def _jump(jumps: DataFrame, scratch: list[str]) -> DataFrame:
    """Pointers to the segment before, doubled by joins until each points to its path's
    first segment.  Those that never get there lie on closed paths and go."""
    rounds = max(1, jumps.count()).bit_length() + 1
    further = lambda j: j.select(F.col("doc").alias("to_doc"), F.col("place").alias("to_place"), F.col("to_doc").alias("n_doc"), F.col("to_place").alias("n_place"), F.col("offset").alias("n_offset"))
    for _ in range(rounds):
        met = jumps.join(further(jumps).hint("merge"), ["to_doc", "to_place"], "left")
        moved = F.col("n_doc").isNotNull()
        step = met.select("doc", "place", F.coalesce("n_doc", "to_doc").alias("to_doc"), F.coalesce("n_place", "to_place").alias("to_place"), (F.col("offset") + F.coalesce("n_offset", F.lit(0))).alias("offset"), moved.alias("moved"))
        step = written(step, "jumps", scratch=scratch)
        jumps = step.drop("moved")
        if step.where("moved").isEmpty():
            return jumps
    return jumps.join(further(jumps).hint("merge"), ["to_doc", "to_place"], "left_anti")


def _kept(docs: DataFrame, id_col: str, text_col: str, k: int, carry: list[str], plain: bool, seed: int) -> DataFrame:
    texts = _texts_by_id(docs, id_col, text_col, carry)
    paths = _verified(texts, _paths(texts, k, seed), k)
    paths = paths.select("doc", F.transform("paths", lambda p: F.struct(p["place"].alias("place"), p["edges"].alias("edges"), p["digest"].alias("digest"))).alias("paths"))
    held = F.coalesce("paths", F.array().cast(paths.schema["paths"].dataType)).alias("paths")
    joined = texts.join(paths.hint("merge"), "doc", "left").select("doc", "text", "part", held, "copy", F.col("doc").alias("id"), "rest")
    kind = texts.schema["rest"].dataType.simpleString()
    return joined.mapInArrow(_keep(k, plain), f"id long, rest {kind}, n_words long, n_removed long, kept_text string")


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, seed: int = 0) -> DataFrame:
    """``docs``' id with ``n_words``, ``n_removed`` and ``kept_text`` (kept words
    joined by one space), a row for each input row."""
    kept = _kept(docs, id_col, text_col, k, [], True, seed)
    back = F.when(F.col("id") < NO_ID, F.col("id")).cast(docs.schema[id_col].dataType)
    return kept.select(back.alias(id_col), "n_words", "n_removed", "kept_text")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 13, seed: int = 0) -> DataFrame:
    """``docs`` with their columns and shortened texts.  A text that loses nothing
    stays as it was; one that loses words is its kept words joined by one space; one
    that loses all its words goes."""
    columns = docs.columns
    kept = _kept(docs, id_col, text_col, k, [c for c in columns if c != text_col], False, seed)
    kept = kept.where("n_words = 0 or n_removed < n_words")
    return kept.select(*(F.col("kept_text").alias(c) if c == text_col else F.col("rest").getField(c).alias(c) for c in columns))
