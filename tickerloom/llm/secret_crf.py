"""Secret scans by a linear-chain conditional random field.

Texts become tokens: runs of letters, digits and ``+/_.-``, and runs of other marks. Each token has a dozen categorical features: its
shape (kinds of characters, alternations, share of digits) against its length, keywords and marks among its neighbours, and
features of the file (density of marks, whether a keyword occurs). A field over the tags *begin*, *inside* and *outside* is
trained by gradient on the exact log-likelihood (forward-backward in numpy), on windows of a bounded sample of documents.

Labels come from two sides: the patterns' finds, and secrets in forms that no pattern expresses (prefixed keys, signed web
tokens, passwords after other words), made up from a seed and put into sampled texts, beside look-alikes (addresses, paths,
versions, days, row ids, long numbers, names with capitals inside) that are taught as outside. Tokens of texts without finds are outside too; their
windows lie anywhere in the whole text, at tokens that look most like secrets first. Texts are decoded by Viterbi; a text
in which no token could leave *outside* even with the best transitions is skipped, which changes nothing.

The patterns' own finds always stay. The field adds spans of kind ``crf`` of ``SHORTEST`` code points and more; what
a find covers is cut out of them and the rest, where it holds a letter or digit, is a span of any length, so that masking
leaves no part of a token that is a secret.

Cases: NULL and empty texts have no span (counts 0, ``spans`` empty, the digest that of the empty text); equal rows give equal
results, one each; positions are code points, also after characters outside the basic plane; where no text has any
token to learn from, only pattern finds are returned; clashing or extra columns are ignored; an empty table gives
an empty result.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bounded_batches, keyed, out_batch, steps, table

#: The patterns that every scan must find, and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16}
KINDS = ("assign", "access", "hex", "crf")
HINTS = (b"password", b"passwd", b"secret", b"token", b"api")

#: Words near a secret, as the features see them.
KEYWORDS = re.compile(rb"password|passwd|pwd|secret|token|api_?key|access|private|credential|bearer|auth|key")
#: Bytes worked on at once.
STEP = 2 << 20
#: Tokens of a training window, and shortest span that the field may add.
WINDOW, SHORTEST = 32, 8
#: Signs of the secrets that are made up for training, and what may stand before one.
SIGNS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
BEFORE = ("bearer ", "authorization: bearer ", "auth ", "key ", "access key is ", "private key: ", "credential = ", "pwd: ", "use ", "")
#: Sizes of the feature tables; see ``featured``.
SIZES = (32 * 16, 8 * 16, 8 * 16, 8, 8, 8, 8, 8 * 16, 4 * 2 * 16, 8 * 8)
COLUMNS = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_crf long"
SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()),
    ("spans", pa.string()), ("n_crf", pa.int64()),
])


def pattern_spans(text: str, low: bytes) -> list[tuple[int, int, int, int]]:
    """(start, end, kind, start of the secret itself) of the patterns' finds, in code points."""
    out = []
    if any(h in low for h in HINTS):
        out += [(m.start(), m.end(), 0, m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), m.end(), 1, m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    out += [(m.start(), m.end(), 2, m.start()) for m in HEX.finditer(text)]
    return sorted(out)


def _classes() -> np.ndarray:
    """Of each byte: 0 white space, 1 other mark, 2 small letter, 3 capital, 4 digit, 5 mark inside tokens, 6 not ASCII."""
    out = np.full(256, 1, np.uint8)
    out[list(b" \t\n\r\x0b\x0c")] = 0
    out[97:123], out[65:91], out[48:58] = 2, 3, 4
    out[list(b"+/_.-")] = 5
    out[128:] = 6
    return out


CLASSES = _classes()
#: Letters a to f of either case, and digits.
HEXISH = np.isin(np.arange(256), list(b"0123456789abcdefABCDEF"))


def tokens(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the tokens of bytes."""
    kind = CLASSES[raw]
    group = np.minimum(kind, 2)
    edge = np.flatnonzero(group[1:] != group[:-1]) + 1
    starts = np.concatenate(([0], edge))
    ends = np.concatenate((edge, [len(raw)]))
    some = group[starts] > 0
    return starts[some], ends[some]


def featured(raw: np.ndarray, low: bytes, doc_start: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Token starts and ends, the document of each token, and its features (tokens x tables) as indices into the tables.

    ``raw``: the bytes of all documents, each followed by a line break; ``low``: the same with small letters.
    """
    starts, ends = tokens(raw)
    n = len(starts)
    doc = np.searchsorted(doc_start, starts, side="right") - 1
    if not n:
        return starts, ends, doc, np.zeros((0, len(SIZES)), np.int32)
    kind = CLASSES[raw]
    bounds = np.empty(2 * n, np.int64)
    bounds[0::2], bounds[1::2] = starts, ends

    def count(flag: np.ndarray) -> np.ndarray:
        return np.add.reduceat(np.append(flag, np.uint8(0)), bounds, dtype=np.int32)[0::2]

    lower, upper, digit, inner, other = (count(kind == k) for k in (2, 3, 4, 5, 6))
    hexish = count(HEXISH[raw])
    turns = count(np.append(kind[1:] != kind[:-1], False)) - 1  # the last one leaves the token
    length = ends - starts
    size = np.minimum(15, np.floor(2 * np.log2(length)).astype(np.int64))
    has = (lower > 0) + 2 * (upper > 0) + 4 * (digit > 0) + 8 * (inner > 0) + 16 * (other > 0)
    share = (7 * digit) // length
    rough = np.minimum(7, (8 * np.maximum(turns, 0)) // length)
    word = kind[starts] >= 2
    near = np.zeros(n, np.int64)  # 0 other, 1 a mark like : or =, 2 a quote, 3 other mark, 4 a keyword, 5 mixed letters and digits
    near[~word] = 3
    first = raw[starts]
    near[~word & np.isin(first, list(b":="))] = 1
    near[~word & np.isin(first, list(b"\"'"))] = 2
    near[word & (digit > 0) & (lower + upper > 0)] = 5
    keyed_at = np.fromiter((m.start() for m in KEYWORDS.finditer(low)), np.int64)
    at = np.searchsorted(starts, keyed_at, side="right") - 1
    near[at[(at >= 0) & word[np.maximum(at, 0)] & (length[np.maximum(at, 0)] < 24)]] = 4

    def moved(by: int) -> np.ndarray:
        out = np.full(n, 7, np.int64)
        if by > 0:
            out[by:] = np.where(doc[by:] == doc[:-by], near[:-by], 7)
        else:
            out[:by] = np.where(doc[:by] == doc[-by:], near[-by:], 7)
        return out

    one, two, three, after = moved(1), moved(2), moved(3), moved(-1)
    docs = len(doc_start)
    marks = np.bincount(doc, weights=inner + ~word * length, minlength=docs) / np.maximum(1, np.bincount(doc, weights=length, minlength=docs))
    dense = np.minimum(3, (marks * 16).astype(np.int64))
    asked = (np.bincount(doc, weights=near == 4, minlength=docs) > 0).astype(np.int64)
    table_of = (
        has * 16 + size, share * 16 + size, rough * 16 + size, one, two, three, after,
        np.minimum(7, (8 * hexish) // (length + 1)) * 16 + size, (dense[doc] * 2 + asked[doc]) * 16 + size, one * 8 + two,
    )
    return starts, ends, doc, np.stack(table_of, axis=1).astype(np.int32)


OFFSETS = np.cumsum((0, *SIZES[:-1]))
B, I, O = 0, 1, 2  # noqa: E741
#: What a tag may follow: not inside after outside or at the start.
ALLOWED = np.array([[True, True, True], [True, True, True], [True, False, True]])


@dataclass(frozen=True)
class Field:
    weights: np.ndarray  # all feature tables, one after another, x tags
    steps: np.ndarray  # from tag x to tag; forbidden ones very low

    def scores(self, features: np.ndarray) -> np.ndarray:
        out = np.zeros((len(features), 3), np.float32)
        for k, base in enumerate(OFFSETS):
            out += self.weights[base + features[:, k]]
        return out

    def slack(self) -> float:
        moves = self.steps - self.steps[O, O]
        return max(0.0, float(moves[ALLOWED].max()))

    def decode(self, scores: np.ndarray) -> list[int]:
        """Best tags (Viterbi)."""
        (bb, bi, bo), (ib, ii, io), (ob, _, oo) = self.steps.tolist()
        b, i, o = float(scores[0, B]), -1e9, float(scores[0, O])
        back = []
        for eb, ei, eo in scores[1:].tolist():
            x, y, z = b + bb, i + ib, o + ob
            fb = B if x >= y and x >= z else I if y >= z else O
            nb = max(x, y, z) + eb
            x, y = b + bi, i + ii
            fi = B if x >= y else I
            ni = max(x, y) + ei
            x, y, z = b + bo, i + io, o + oo
            fo = O if z >= x and z >= y else B if x >= y else I
            o = max(x, y, z) + eo
            b, i = nb, ni
            back.append((fb, fi, fo))
        tag = O if o >= b and o >= i else B if b >= i else I
        tags = [tag]
        for links in reversed(back):
            tag = links[tag]
            tags.append(tag)
        return tags[::-1]


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def train(windows: list[tuple[np.ndarray, np.ndarray]], epochs: int = 80, decay: float = 1e-3) -> Field | None:
    """Maximum likelihood with squared-norm decay; windows: (features, tags)."""
    windows = [w for w in windows if len(w[1])]
    if not any((tags != O).any() for _, tags in windows):
        return None
    most, n = max(len(t) for _, t in windows), len(windows)
    feats = np.zeros((n, most, len(SIZES)), np.int64)
    tags = np.full((n, most), O)
    real = np.zeros((n, most), bool)
    for k, (f, t) in enumerate(windows):
        feats[k, :len(t)], tags[k, :len(t)], real[k, :len(t)] = f + OFFSETS, t, True
    ban = np.where(ALLOWED, 0.0, -1e4)
    w, s = np.zeros((sum(SIZES), 3)), np.zeros((3, 3))
    state = [np.zeros_like(w), np.zeros_like(w), np.zeros_like(s), np.zeros_like(s)]
    gold = np.eye(3)[tags] * real[..., None]
    pairs = np.zeros((3, 3))
    both = real[:, 1:]
    np.add.at(pairs, (tags[:, :-1][both], tags[:, 1:][both]), 1)
    flat = feats[real]
    for epoch in range(1, epochs + 1):
        e = np.zeros((n, most, 3))
        e[real] = sum(w[flat[:, k]] for k in range(len(SIZES)))
        move = s + ban
        alpha = np.empty((n, most, 3))
        alpha[:, 0] = e[:, 0] + np.array([0, -1e4, 0])
        for t in range(1, most):
            new = _log_sum(alpha[:, t - 1, :, None] + move, 1) + e[:, t]
            alpha[:, t] = np.where(real[:, t, None], new, alpha[:, t - 1])
        beta = np.zeros((n, most, 3))
        for t in range(most - 2, -1, -1):
            new = _log_sum(move + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
            beta[:, t] = np.where(real[:, t + 1, None], new, 0)
        norm = _log_sum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - norm[:, None, None]) * real[..., None]
        link = alpha[:, :-1, :, None] + move + (e[:, 1:] + beta[:, 1:])[:, :, None, :] - norm[:, None, None, None]
        link = (np.exp(np.minimum(link, 0)) * both[..., None, None]).sum(axis=(0, 1))
        g = (node - gold)[real]
        gw = np.zeros_like(w)
        for k in range(len(SIZES)):
            for tag in range(3):
                gw[:, tag] += np.bincount(flat[:, k], weights=g[:, tag], minlength=len(w))
        for value, grad, m, v in ((w, gw / n + decay * w, *state[:2]), (s, (link - pairs) / n + decay * s, *state[2:])):
            m += 0.1 * (grad - m)
            v += 0.01 * (grad ** 2 - v)
            value -= 0.1 * (m / (1 - 0.9 ** epoch)) / (np.sqrt(v / (1 - 0.99 ** epoch)) + 1e-8)
    return Field(w.astype(np.float32), s + ban)


def _joined(texts: list[str]) -> tuple[np.ndarray, bytes, np.ndarray, list[bytes]]:
    parts = [t.encode() for t in texts]
    data = b"\n".join(parts) + b"\n"
    sizes = np.array([len(p) + 1 for p in parts], np.int64)
    low = data.lower()
    return np.frombuffer(data, np.uint8), low, np.cumsum(sizes) - sizes, parts


def _bytes_at(part: bytes, text: str, points: list[int]) -> list[int]:
    """Byte offsets of code points, in one walk over the text."""
    if len(part) == len(text):
        return points
    at, offset, out = 0, 0, {}
    for p in sorted(set(points)):
        offset += len(text[at:p].encode())
        at = p
        out[p] = offset
    return [out[p] for p in points]


def _points_at(part: bytes, offsets: list[int]) -> list[int]:
    """Code points of byte offsets, in one walk over the text."""
    at, point, out = 0, 0, {}
    for b in sorted(set(offsets)):
        point += len(part[at:b].decode())
        at = b
        out[b] = point
    return [out[b] for b in offsets]


def _tagged_spans(texts: list[str], parts: list[bytes], spans: list[list], doc_start: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Tags of the tokens by spans (.., end, .., start of the secret)."""
    tags = np.full(len(starts), O)
    for d, found in enumerate(spans):
        if not found:
            continue
        at = np.array(_bytes_at(parts[d], texts[d], [p for _, end, _, inner in found for p in (inner, end)]), np.int64) + doc_start[d]
        lows, highs = np.searchsorted(ends, at[0::2], side="right"), np.searchsorted(starts, at[1::2], side="left")
        for lo, hi in zip(lows.tolist(), highs.tolist(), strict=True):
            if lo < hi:
                tags[lo:hi] = I
                tags[lo] = B
    return tags


def _signs(rng: np.random.Generator, n: int, signs: str = SIGNS) -> str:
    return "".join(signs[i] for i in rng.integers(0, len(signs), n).tolist())


def made_secret(rng: np.random.Generator) -> str:
    """A secret in a form that the patterns do not know: prefixed key, signed web token, plain random signs, key around hex digits."""
    form, name = rng.integers(0, 5), _signs(rng, int(rng.integers(2, 6)), SIGNS[26:52])
    if form == 0:
        return name + "_-"[rng.integers(0, 2)] + _signs(rng, int(rng.integers(16, 48)))
    if form == 1:
        return ".".join(_signs(rng, n, SIGNS + "_-") for n in rng.integers(18, 120, 3).tolist())
    if form == 2:
        return _signs(rng, int(rng.integers(14, 64)), SIGNS + "+/")
    if form == 3:
        return name + "_" + _signs(rng, 32, "0123456789abcdef") + _signs(rng, int(rng.integers(0, 8)))
    return _signs(rng, int(rng.integers(20, 40)), SIGNS[:26] + SIGNS[52:])


def made_decoy(rng: np.random.Generator) -> str:
    """Something clean that is long or mixes kinds of characters."""
    def word(least: int = 3, most: int = 10) -> str:
        return _signs(rng, int(rng.integers(least, most)), SIGNS[26:52])

    number = rng.integers(1, 2030, 4).tolist()
    return (
        lambda: f"www.{word()}.{word(2, 4)}/{word()}/{word()}-{word()}.html", lambda: f"{word()}/{word()}/{word()}_{word()}.{word(1, 4)}",
        lambda: f"v{number[0] % 20}.{number[1] % 20}.{number[2] % 99}", lambda: f"{number[0]}-{number[1] % 12 + 1:02}-{number[2] % 28 + 1:02}",
        lambda: word() + word().title() + word().title(), lambda: "_".join(word() for _ in range(4)), lambda: "-".join(word() for _ in range(3)),
        lambda: f"{word().upper()}-{number[0]}-{number[1] % 9}", lambda: ".".join(str(x % 256) for x in number), lambda: f"{word()}{number[3] % 100}",
        lambda: word(14, 30), lambda: word(10, 20).upper(), lambda: "-".join(str(x) for x in number),
        lambda: "-".join(_signs(rng, n, "0123456789abcdef") for n in (8, 4, 4, 4, 12)),
        lambda: _signs(rng, int(rng.integers(6, 20)), SIGNS[52:]),
    )[rng.integers(0, 15)]()


def seeded(text: str, rng: np.random.Generator, each: int = 2) -> tuple[str, list[tuple[int, int, int, int]], list[int]]:
    """The text with made-up secrets and look-alikes between its words: (new text, spans of the secrets, starts of the look-alikes)."""
    places = np.sort(rng.integers(0, len(text) + 1, 2 * each)).tolist()
    out, size, at, spans, decoys = [], 0, 0, [], []
    for place, secret in zip(places, rng.permutation(2 * each) < each, strict=True):
        place = text.find(" ", max(at, place))
        place = len(text) if place < 0 else place
        lead = text[at:place] + " " + BEFORE[rng.integers(0, len(BEFORE))]
        thing = made_secret(rng) if secret else made_decoy(rng)
        start = size + len(lead)
        out += [lead, thing, " "]
        size, at = start + len(thing) + 1, place
        if secret:
            spans.append((start, start + len(thing), 3, start))
        else:
            decoys.append(start)
    return "".join([*out, text[at:]]), spans, decoys


def _suspects(features: np.ndarray, most: int, rng: np.random.Generator) -> np.ndarray:
    """Tokens of a clean text to learn from: most turns and kinds of characters first, and one anywhere."""
    n = len(features)
    if not n:
        return np.zeros(0, np.int64)
    kinds = features[:, 0] // 16
    odd = np.sum([(kinds & 7) > 4, (kinds & 3) == 3, features[:, 2] // 16 >= 2, features[:, 0] % 16 >= 8], axis=0)
    top = np.argpartition(-odd, most - 1)[:most - 1] if n >= most else np.arange(n)
    return np.unique(np.append(top[odd[top] > 0], rng.integers(0, n)))


def window_batches(batches: Iterator[pa.RecordBatch], windows: int, rest: int) -> Iterator[pa.RecordBatch]:
    """Training windows: around finds of every document that has any; of one in ``rest`` of the others, clean and with seeded secrets."""
    schema = pa.schema([("found", pa.bool_()), ("mark", pa.int64()), ("n", pa.int32()), ("features", pa.binary()), ("tags", pa.binary())])
    for batch in steps(batches, limit=STEP):
        work: list[tuple[str, list, int, bool, list[int] | None]] = []  # text, spans, mark, found, look-alikes (None: clean as it is)
        for text, mark in zip(batch.column("text").to_pylist(), batch.column("mark").to_pylist(), strict=True):
            spans = pattern_spans(text, text.encode().lower())
            if spans:
                work.append((text, spans, mark, True, []))
            elif text and mark % rest == 0:
                work.append((text, [], mark, False, None))
                new, spans, decoys = seeded(text, np.random.default_rng(mark))
                work.append((new, spans, mark, False, decoys))
        rows: dict[str, list] = {f.name: [] for f in schema}
        if work:
            texts, all_spans = [w[0] for w in work], [w[1] for w in work]
            raw, low, doc_start, parts = _joined(texts)
            starts, ends, doc, feats = featured(raw, low, doc_start)
            tags = _tagged_spans(texts, parts, all_spans, doc_start, starts, ends)
            edges = np.searchsorted(doc, np.arange(len(texts) + 1))
            for d, (text, _, mark, found, decoys) in enumerate(work):
                lo, hi = int(edges[d]), int(edges[d + 1])
                if decoys is None:
                    begins = lo + _suspects(feats[lo:hi], windows // 2, np.random.default_rng(mark))
                else:
                    begins = lo + np.flatnonzero(tags[lo:hi] == B)[:windows]
                    at = np.array(_bytes_at(parts[d], text, decoys), np.int64) + doc_start[d]
                    begins = np.sort(np.append(begins, np.searchsorted(starts, at)))
                done = lo
                for at in begins.tolist():
                    a = max(done, at - WINDOW // 2)
                    b = min(hi, a + WINDOW)
                    while a < b and tags[a] == I:
                        a += 1
                    if at < done or a >= b:
                        continue
                    while b < hi and b > a and tags[b] == I:
                        b -= 1
                    done = max(b, a + 1)
                    part = (found, int(mark), b - a, feats[a:b].tobytes(), tags[a:b].astype(np.uint8).tobytes())
                    for name, value in zip(rows, part, strict=True):
                        rows[name].append(value)
        yield out_batch(schema, **rows)


def fit(docs: DataFrame, key: str = "doc_id", text: str = "text", sample: int = 400, windows: int = 4) -> Field | None:
    """Train on at most ``windows * sample`` windows of documents with finds, and as many of documents without (smallest by a hash)."""
    bounded_batches(docs.sparkSession)
    rest = max(1, docs.count() // (8 * sample))  # a bounded number of texts without finds is looked at, at every size
    own = keyed(docs, key, text).select("text", F.abs(F.xxhash64("doc_id", F.length("text")) % (1 << 40)).alias("mark"))
    cut = own.mapInArrow(lambda it: window_batches(it, windows, rest), "found boolean, mark long, n int, features binary, tags binary")
    halves = [cut.where(c).orderBy("mark", "n", "features").limit(windows * sample) for c in ("found", "NOT found")]
    got = halves[0].union(halves[1]).collect()
    pairs = [(np.frombuffer(r.features, np.int32).reshape(r.n, -1).astype(np.int64), np.frombuffer(r.tags, np.uint8).astype(np.int64)) for r in got]
    return train(pairs)


def field_spans(texts: list[str], field: Field | None) -> list[list[tuple[int, int]]]:
    """Spans of every text that the field tags, in code points."""
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    if field is None or not texts:
        return out
    raw, low, doc_start, parts = _joined(texts)
    starts, ends, doc, feats = featured(raw, low, doc_start)
    scores = field.scores(feats)
    open_ = np.maximum(scores[:, B], scores[:, I]) - scores[:, O] + 2 * field.slack() >= 0
    edges = np.searchsorted(doc, np.arange(len(texts) + 1))
    for d in np.unique(doc[open_]).tolist():
        lo, hi = edges[d], edges[d + 1]
        spans, begun = [], -1
        for k, tag in enumerate([*field.decode(scores[lo:hi]), O]):
            if begun >= 0 and tag != I:
                spans.append((int(starts[lo + begun] - doc_start[d]), int(ends[lo + k - 1] - doc_start[d])))
                begun = -1
            if tag == B:
                begun = k
        if spans and len(parts[d]) != len(texts[d]):
            flat = _points_at(parts[d], [x for span in spans for x in span])
            spans = list(zip(flat[0::2], flat[1::2], strict=True))
        out[d] = [(a, b) for a, b in spans if b - a >= SHORTEST]
    return out


def uncovered(added: list[tuple[int, int]], base: list[tuple[int, int]], text: str) -> list[tuple[int, int]]:
    """What of the added spans no base span covers, where it holds a letter or digit; one sweep over both lists, sorted by start."""
    out, i = [], 0
    for a, b in added:
        while i < len(base) and base[i][1] <= a:
            i += 1
        at, k = a, i
        while k < len(base) and base[k][0] < b:
            if base[k][0] > at:
                out.append((at, base[k][0]))
            at = max(at, base[k][1])
            k += 1
        i = max(i, k - 1)
        if at < b:
            out.append((at, b))
    return [(a, b) for a, b in out if any(c.isalnum() for c in text[a:b])]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def find_spans(texts: list[str], field: Field | None) -> list[list[tuple[int, int, int]]]:
    """(start, end, kind) of all spans of every text: the patterns' finds, and what the field adds beside them."""
    out = []
    for text, added in zip(texts, field_spans(texts, field), strict=True):
        found = [(a, b, k) for a, b, k, _ in pattern_spans(text, text.encode().lower())]
        if added:
            found += [(a, b, 3) for a, b in uncovered(added, _merged([(a, b) for a, b, _ in found]), text)]
        out.append(sorted(found, key=lambda s: (s[0], s[2], s[1])))
    return out


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan_batches(batches: Iterator[pa.RecordBatch], field: Field | None) -> Iterator[pa.RecordBatch]:
    for batch in steps(batches, limit=STEP):
        cols: dict[str, list] = {f.name: [] for f in SCHEMA if f.name != "doc_id"}
        for spans in find_spans(batch.column("text").to_pylist(), field):
            base = [s for s in spans if s[2] < 3]
            n = [sum(k == i for _, _, k in spans) for i in range(4)]
            row = (*n[:3], hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans), n[3])
            for name, value in zip(cols, row, strict=True):
                cols[name].append(value)
        yield out_batch(SCHEMA, doc_id=batch.column("doc_id"), **cols)


def secret_scan(docs: DataFrame, field: Field | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: the patterns' counts and digest, all spans, and how many the field added."""
    bounded_batches(docs.sparkSession)
    return keyed(docs, key, text).mapInArrow(lambda it: scan_batches(it, field), COLUMNS)


def masked(text: str, spans: list[tuple[int, int, int]], mask: str) -> str:
    """The text with every span (or run of overlapping spans) replaced."""
    out, at, done = [], 0, 0
    for a, b, _ in spans:
        if a >= done:
            out += [text[at:a], mask]
        done = at = max(done, b)
    return "".join([*out, text[at:]])


def _mask_batches(batches: Iterator[pa.RecordBatch], field: Field | None, column: str, mask: str) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        at = whole.schema.get_field_index(column)
        null = whole.column(at).is_null().to_pylist()
        out: list[str | None] = []
        for batch in steps(iter([whole]), column, STEP):
            texts = batch.column(at).to_pylist()
            out += [masked(t, s, mask) if s else t for t, s in zip(texts, find_spans(texts, field), strict=True)]
        out = [None if n else t for n, t in zip(null, out, strict=True)]
        yield whole.set_column(at, whole.schema.field(at), pa.array(out, whole.schema.field(at).type))


def mask_secrets(docs: DataFrame, field: Field | None, text: str = "text", mask: str = "[secret]") -> DataFrame:
    """The same rows and columns with secrets in ``text`` replaced by ``mask``."""
    bounded_batches(docs.sparkSession)
    return docs.mapInArrow(lambda it: _mask_batches(it, field, text, mask), docs.schema)


def op2_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return secret_scan(docs, fit(docs))
