"""SentencePiece encoding and decoding with byte offsets into the source.

A text is normalised by longest prefixes of the model's compiled character map, while an alignment records for every
byte of the normal form the source byte it comes from. The library's merges run on the normal form, and each piece is
projected through the alignment to the source bytes it covers.

The normal form is cut before each run of the space symbol. Where no piece of a BPE model goes on over such a cut
(checked when the model is read), merges never cross it: the pieces of a text are those of its cuts, and each distinct
cut goes through the library once. Other models get whole texts.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomline.llm.token_counts import text_slices

SPACE = "▁"
SPACE_BYTES = SPACE.encode()


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def read_charsmap(blob: bytes) -> dict[bytes, bytes]:
    """Source sequence -> normal form, read off a compiled map.

    The map is a size, a double-array trie of 32-bit units and a pool of zero-ended strings; a trie value is an offset
    into the pool. The whole trie is walked once from its root.
    """
    if not blob:
        return {}
    (size,) = struct.unpack_from("<I", blob)
    units = np.frombuffer(blob, "<u4", size // 4, 4)
    pool = blob[4 + size :]
    shift = lambda u: (u >> 10) << ((u & 0x200) >> 6)
    labels = np.arange(1, 256, dtype=np.uint32)
    found: dict[bytes, bytes] = {}
    bases, keys = shift(units[:1]), [b""]
    while len(keys):  # one level of the trie at a time
        next_bases, next_keys = [], []
        for i in range(0, len(keys), 4096):
            at = bases[i : i + 4096, None] ^ labels
            inside = at < len(units)
            node, label = np.nonzero(inside & (units[np.where(inside, at, 0)] & 0x800000FF == labels))
            at = at[node, label]
            child = at ^ shift(units[at])
            own = [keys[i + n] + bytes((c + 1,)) for n, c in zip(node.tolist(), label.tolist(), strict=True)]
            for k in np.flatnonzero(units[at] & 0x100).tolist():  # a value hangs below
                start = int(units[child[k]] & 0x7FFFFFFF)
                found[own[k]] = pool[start : pool.index(b"\0", start)]
            next_bases.append(child)
            next_keys += own
        bases, keys = np.concatenate(next_bases), next_keys
    return found


@dataclass
class Normal:
    text: bytes
    source: np.ndarray  # for each byte of text the source byte it comes from, and the end


class Normalizer:
    def __init__(self, spec, trainer, symbols: list[str] = ()):
        mapped = read_charsmap(spec.precompiled_charsmap)
        own = {s.encode(): s.encode() for s in symbols}
        self.map = mapped | own
        self.strip = spec.remove_extra_whitespaces
        self.dummy = spec.add_dummy_prefix
        self.escape = spec.escape_whitespaces
        self.suffix = trainer.treat_whitespace_as_suffix
        #: For each first character the lengths its keys have: the model's own symbols before the map, longest first.
        self.lengths: dict[str, list[int]] = {}
        for part in (mapped, own):
            by_first: dict[str, set[int]] = {}
            for key in (x.decode() for x in part):
                by_first.setdefault(key[0], set()).add(len(key))
            for c, found in by_first.items():
                self.lengths[c] = sorted(found, reverse=True) + self.lengths.get(c, [])
        self.pattern = re.compile("[" + "".join(map(re.escape, self.lengths)) + "]") if self.lengths else None

    def _chunks(self, text: str) -> Iterator[tuple[bytes, bytes]]:
        """(normal form, source): mapped sequences one by one, stretches without any as they are (the same object)."""
        at = seek = 0
        while self.pattern and (m := self.pattern.search(text, seek)):
            i = m.start()
            for n in self.lengths[text[i]]:
                source = text[i : i + n].encode()
                if source in self.map:
                    if i > at:
                        plain = text[at:i].encode()
                        yield plain, plain
                    yield self.map[source], source
                    at = seek = i + n
                    break
            else:
                seek = i + 1
        if at < len(text):
            plain = text[at:].encode()
            yield plain, plain

    def _aligned(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Bytes before white space is dealt with, and the source byte of each: a mapped byte has its sequence's start,
        another its own place."""
        if not self.pattern:
            flat = np.frombuffer(text.encode(), np.uint8)
            return flat, np.arange(len(flat))
        out, where, at = [], [], 0
        for normal, source in self._chunks(text):
            out.append(normal)
            where.append(at + np.arange(len(source)) if normal is source else np.full(len(normal), at))
            at += len(source)
        return np.frombuffer(b"".join(out), np.uint8), np.concatenate(where)

    def _first(self, text: str) -> int:
        """The source byte after the leading sequences whose normal form is one space."""
        at = 0
        for normal, source in self._chunks(text):
            if normal is source:
                at += len(source) - len(source.lstrip(b" "))
                if source.strip(b" "):
                    break
            elif normal != b" ":
                break
            else:
                at += len(source)
        return at

    def __call__(self, text: str) -> Normal:
        """The normal form of a whole text. An empty text has an empty one, without the dummy prefix."""
        end = len(text.encode())
        if not end:
            return Normal(b"", np.zeros(1, np.int64))
        flat, starts = self._aligned(text)
        if not self.pattern and (high := flat & 0xC0 == 0x80).any():
            # inside a character every byte stands for the character's start
            starts = np.maximum.accumulate(np.where(high, 0, starts))
        elif self.pattern:
            starts = _character_starts(text, starts)
        first = 0
        if self.strip:
            first = self._first(text)
            if first == end:
                return Normal(b"", np.zeros(1, np.int64))
            blank = flat == 0x20
            keep = ~(blank & np.concatenate(([True], blank[:-1])))
            flat, starts = flat[keep], starts[keep]
        blank = flat == 0x20
        symbol = np.frombuffer(SPACE_BYTES if self.escape else b" ", np.uint8)
        size = np.where(blank, len(symbol), 1)
        out = np.repeat(flat, size)
        where = np.repeat(starts, size)
        if self.escape:
            hit = np.cumsum(size)[blank] - len(symbol)
            for k in range(len(symbol)):
                out[hit + k] = symbol[k]
        if self.dummy and not self.suffix:
            out, where = np.concatenate((symbol, out)), np.concatenate((np.full(len(symbol), first), where))
        normal = out.tobytes()
        if self.strip:
            n = len(normal)
            while normal.endswith(symbol.tobytes(), 0, n):
                n -= len(symbol)
                end = int(where[n])
            normal, where = normal[:n], where[:n]
        if self.dummy and self.suffix:
            normal, where = normal + symbol.tobytes(), np.concatenate((where, np.full(len(symbol), end)))
        return Normal(normal, np.append(where, end))


def _character_starts(text: str, starts: np.ndarray) -> np.ndarray:
    raw = np.frombuffer(text.encode(), np.uint8)
    at = np.maximum.accumulate(np.where(raw & 0xC0 == 0x80, 0, np.arange(len(raw))))
    return at[starts]


class Codec:
    """Ids, spans and decoded text of whole texts, as the library gives them for the model, without begin or end ids."""

    def __init__(self, model_path: str | None = None, proto: bytes | None = None, max_units: int = 400_000):
        import sentencepiece as spm
        from sentencepiece import sentencepiece_model_pb2 as pb

        if proto is None:
            with open(model_path or default_model(), "rb") as f:
                proto = f.read()
        model = pb.ModelProto.FromString(proto)
        kinds = model.SentencePiece.Type
        symbols = [p.piece for p in model.pieces if p.type == kinds.USER_DEFINED]
        self.library = spm.SentencePieceProcessor(model_proto=proto)
        self.normalizer = Normalizer(model.normalizer_spec, model.trainer_spec, symbols)
        crossing = any(SPACE in p.piece.lstrip(SPACE) for p in model.pieces if p.type != kinds.CONTROL)
        self.cuttable = (
            model.trainer_spec.model_type == pb.TrainerSpec.BPE
            and self.normalizer.escape
            and not symbols
            and not crossing
        )
        plain = model.normalizer_spec
        plain.name, plain.precompiled_charsmap = "identity", b""
        plain.add_dummy_prefix = plain.remove_extra_whitespaces = plain.escape_whitespaces = False
        self.merges = spm.SentencePieceProcessor(model_proto=model.SerializeToString())
        self.max_units = max_units
        #: Bytes of the normal form that a piece takes; 0 where that depends on the text (unknown pieces).
        self.width = np.array(
            [0 if p.type == kinds.UNKNOWN else 1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces],
            np.int64,
        )
        self.index: dict[str, int] = {}
        self.count, self.start, self.size = array("q"), array("q"), array("q")  # of a unit: pieces, first one, bytes
        self.ids, self.begin, self.end = array("i"), array("i"), array("i")  # of a piece; bytes from the unit's start

    def _learn(self, units: list[str]) -> None:
        """Units that begin, and don't end, with a space go through the library in strings of many: no merge crosses from
        one to the next."""
        joined: list[list[str]] = []
        held = STRING
        for u in units:
            if not self.cuttable or not u.startswith(SPACE) or u.endswith(SPACE):
                joined.append([u])
                held = STRING
                continue
            if held >= STRING:
                joined.append([])
                held = 0
            joined[-1].append(u)
            held += len(u)
        for i in range(0, len(joined), 256):
            part = joined[i : i + 256]
            for us, ids in zip(part, self.merges.encode(["".join(us) for us in part], return_type="numpy", num_threads=1), strict=True):
                width = self.width[ids]
                if len(us) == 1 or not width.all():
                    self._learn_slowly(us)
                    continue
                end = np.cumsum(width)
                size = np.array([len(u.encode()) for u in us], np.int64)
                stop = np.cumsum(size)
                last = np.searchsorted(end, stop) + 1
                count = np.diff(last, prepend=0)
                from_unit = np.repeat(stop - size, count)
                self.start.extend((len(self.ids) + last - count).tolist())
                self.count.extend(count.tolist())
                self.size.extend(size.tolist())
                self.ids.frombytes(ids.astype(np.int32).tobytes())
                self.begin.frombytes((end - width - from_unit).astype(np.int32).tobytes())
                self.end.frombytes((end - from_unit).astype(np.int32).tobytes())
                for u in us:
                    self.index[u] = len(self.index)

    def _learn_slowly(self, units: list[str]) -> None:
        got = self.merges.encode(units, return_type="offset_mapping", return_bytes=True, num_threads=1)
        for u, found in zip(units, got, strict=True):
            self.index[u] = len(self.index)
            self.start.append(len(self.ids))
            self.count.append(len(found["ids"]))
            self.size.append(len(u.encode()))
            self.ids.extend(found["ids"])
            self.begin.extend([x for x, _ in found["offsets"]])
            self.end.extend([y for _, y in found["offsets"]])

    def _forget(self, units: list[str], known: int) -> None:
        """Drop what was learned beyond the first ``known`` units; frequent ones came early and stay."""
        for u in units:
            del self.index[u]
        pieces = self.start[known]
        del self.count[known:], self.start[known:], self.size[known:]
        del self.ids[pieces:], self.begin[pieces:], self.end[pieces:]

    def _units(self, normal: bytes) -> list[str]:
        if not normal:
            return []
        text = normal.decode()
        if not self.cuttable:
            return [text]
        head, *rest = text.split(SPACE)
        if "" not in rest:
            return ([head] if head else []) + [SPACE + x for x in rest]
        return RUN.findall(text)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, begin, end of all pieces one after another, and where each text's pieces begin (and the last end)."""
        normals = [self.normalizer(t) for t in texts]
        units = [self._units(n.text) for n in normals]
        flat = [u for us in units for u in us]
        missing = [u for u in dict.fromkeys(flat) if u not in self.index]
        known = len(self.index)
        self._learn(missing)
        which = np.fromiter(map(self.index.__getitem__, flat), np.int64, len(flat))
        per_text = np.fromiter(map(len, units), np.int64, len(units))
        view = lambda x: np.frombuffer(x, f"<{x.typecode}{x.itemsize}".replace("q", "i")) if x else np.zeros(0, np.int64)
        count = view(self.count)[which]
        total = int(count.sum())
        before = np.cumsum(count) - count
        at = np.arange(total) + np.repeat(view(self.start)[which] - before, count)
        # units stand one after another in the normal forms, which are laid end to end with one closing entry each
        size = view(self.size)[which]
        text_of_unit = np.repeat(np.arange(len(units)), per_text)
        shift = np.cumsum(size) - size + text_of_unit
        source = np.concatenate([n.source for n in normals]) if normals else np.zeros(0, np.int64)
        move = np.repeat(shift, count)
        begin, end = source[view(self.begin)[at] + move], source[view(self.end)[at] + move]
        bounds = np.concatenate(([0], np.cumsum(np.bincount(text_of_unit, count, len(units)).astype(np.int64))))
        out = view(self.ids)[at], begin.astype(np.int32), end.astype(np.int32), bounds
        if len(self.index) > self.max_units and known < len(self.index):
            keep = max(known, min(self.max_units, len(self.index)))
            self._forget([u for u in missing if self.index[u] >= keep], keep) if keep < len(self.index) else None
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.library.decode(ids, num_threads=1) if ids else []


#: Characters of a string that units are joined to.
STRING = 4096
RUN = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+$")

SCHEMA = "ids array<int>, begins array<int>, ends array<int>, decoded string"


@lru_cache(maxsize=2)
def _codec(model_path: str) -> Codec:
    """One a worker: what it has learned serves the worker's later tasks."""
    return Codec(model_path)


def _coder(model_path: str, keep: list[str], slice_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column("__text").to_pylist()]
            for a, b in text_slices(texts, slice_chars):
                ids, begin, end, bounds = codec.encode(texts[a:b])
                flat = ids.tolist()
                decoded = codec.decode([flat[x:y] for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)])
                offsets = pa.array(bounds, pa.int32())
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x)) for x in (ids, begin, end)]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k).slice(a, b - a) for k in keep), *lists, pa.array(decoded, pa.string())],
                    names=[*keep, "ids", "begins", "ends", "decoded"],
                )

    return run


def piece_codec(
    docs: DataFrame,
    model_path: str | None = None,
    text_col: str = "text",
    keep: tuple[str, ...] = ("doc_id",),
    slice_chars: int = 1_000_000,
) -> DataFrame:
    """``keep``, ids, begins, ends (source bytes of each piece, end excluded) and decoded for every row, whole texts.

    A piece of a byte that is not its character's last covers no source bytes, and the last covers the whole character.
    A null text is an empty one: empty arrays and an empty decoded text. Rows are handled one by one, so equal or null
    ids and repeated rows stay; other columns don't enter the result. An empty table gives an empty result. At most
    ``slice_chars`` characters are held encoded at once (or one longer text).
    """
    rows = docs.select(*keep, F.col(text_col).alias("__text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)])
    return rows.mapInArrow(_coder(model_path or default_model(), list(keep), slice_chars), f"{kept}, {SCHEMA}")
