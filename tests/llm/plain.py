"""Plain versions of the operators, for small inputs: whatever is simplest and plainly right."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict
from html.parser import HTMLParser

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def measures(text):
    text = text or ""
    ws = WORD.findall(text)
    lines = [x for x in text.split("\n") if WORD.search(x)]
    windows = Counter(zip(ws, ws[1:], ws[2:]))
    covered = set()
    for i, w in enumerate(zip(ws, ws[1:], ws[2:])):
        if windows[w] > 1:
            covered |= {i, i + 1, i + 2}
    return {"n_words": len(ws), "word_chars": sum(map(len, ws)), "n_symbols": len(re.findall(r"[#*$%&|<>]", text)),
            "n_dup_lines": len(lines) - len(set(lines)), "n_lines": len(lines), "n_repeat_words": len(covered)}


def good(text):
    m = measures(text)
    n = m["n_words"]
    return not (n < 50 or 100 * m["n_repeat_words"] > 50 * n or 10 * m["n_symbols"] > n or m["word_chars"] < 3 * n
                or m["word_chars"] > 10 * n or (100 * m["n_dup_lines"] > 30 * m["n_lines"] and m["n_dup_lines"] > 1))


def exact_groups(rows):
    """{index: (keep_id, size)} for rows (doc_id, text)."""
    groups = defaultdict(list)
    for i, (_, t) in enumerate(rows):
        groups[lower_ascii(t or "")].append(i)
    out = {}
    for g in groups.values():
        ids = [rows[i][0] for i in g if rows[i][0] is not None]
        for i in g:
            out[i] = (max(ids) if ids else None, len(g))
    return out


def weighted(text, idf_of):
    ws = [w.lower() for w in (text or "").encode().split()]
    n = min(5, len(ws))
    tf = Counter(tuple(ws[i:i + n]) for i in range(len(ws) - n + 1)) if n else {}
    return {s: c * sum(idf_of(w) for w in s) / len(s) for s, c in tf.items()}


def jaccard(a, b):
    if not a or not b:
        return float(not a and not b)
    low = sum(min(a[x], b[x]) for x in a.keys() & b.keys())
    return low / (sum(a.values()) + sum(b.values()) - low)


def near_classes(texts, idf_of, least=0.8):
    """(index of the first text of its class, closest call) for each text, over all pairs."""
    sets = [weighted(t, idf_of) for t in texts]
    root = list(range(len(sets)))
    margin = 1.0

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            s = jaccard(sets[i], sets[j])
            margin = min(margin, abs(s - least))
            if s >= least:
                a, b = sorted((top(i), top(j)))
                root[b] = a
    return [top(i) for i in range(len(sets))], margin


def mix(rows, weights=(3, 1, 2), share=1.5, most=2, seed=17):
    """[times] for rows (doc_id, source, size)."""
    order = lambda s: (s is None, (s or "").encode())
    sources = sorted({r[1] for r in rows}, key=order)
    size = {s: sum(r[2] for r in rows if r[1] == s) for s in sources}
    weight = {s: weights[i % len(weights)] for i, s in enumerate(sources)}
    full: set = set()
    while True:
        rest = share * sum(size.values()) - sum(most * size[s] for s in full)
        free = sum(weight[s] for s in sources if s not in full)
        more = {s for s in sources if s not in full and most * size[s] <= rest * weight[s] / free}
        if not more:
            break
        full |= more
    times = [0] * len(rows)
    target = {}
    for s in sources:
        target[s] = float(most * size[s]) if s in full else rest * weight[s] / free
        whole = int(target[s] // size[s]) if size[s] else 0
        need = target[s] - whole * size[s]
        mine = sorted((hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest(), i) for i, r in enumerate(rows) if r[1] == s)
        again, upto, left = set(), 0, []
        by_hash = defaultdict(list)
        for h, i in mine:
            by_hash[h].append(i)
        for h in sorted(by_hash):
            z = sum(rows[i][2] for i in by_hash[h])
            if need > 0 and not left and upto + z < need:
                again |= set(by_hash[h])
                upto += z
            else:
                left.append(h)
        gap = need - upto
        offers = [(abs(rows[i][2] - gap), h) for h in left for i in by_hash[h] if need > 0 and rows[i][2] > 0 and abs(rows[i][2] - gap) < gap]
        if offers:
            again |= set(by_hash[min(offers)[1]])
        for _, i in mine:
            times[i] = whole + (i in again)
    return times, target


class _Article(HTMLParser):
    """Blocks of text inside <article>."""

    BLOCKS = {"p", "h1", "h2", "h3", "br", "li", "ul", "div", "article", "footer", "blockquote"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.inside, self.blocks, self.now = 0, [], []

    def cut(self):
        text = re.sub(r"\s+", " ", "".join(self.now)).strip()
        self.now = []
        if text:
            self.blocks.append(text)

    def handle_starttag(self, tag, attrs):
        if tag in self.BLOCKS:
            self.cut()
        self.inside += tag == "article"

    def handle_endtag(self, tag):
        if tag in self.BLOCKS:
            self.cut()
        self.inside -= tag == "article"

    def handle_data(self, data):
        if self.inside:
            self.now.append(data)


def article(page):
    p = _Article()
    p.feed(page or "")
    p.close()
    p.cut()
    return "\n".join(p.blocks)


def agenda(pieces, text, key, dropout, skipped):
    """Merge-dropout on the whole text, one merge at a time, by looking at every pair each time."""
    if not text:
        return []
    code = [0x2581, *(0x110000 if ord(c) == 0x2581 else 0x2581 if c == " " else ord(c) for c in text)]
    sym = [(int(pieces.char[c]), i, i + 1, c) for i, c in enumerate(code)]
    while True:
        best = None
        for k in range(len(sym) - 1):
            a, b = sym[k], sym[k + 1]
            piece = pieces.merges.get(a[0] * pieces.width + b[0]) if a[0] >= 0 and b[0] >= 0 else None
            one = lambda x: np.array([x], np.int64)
            if piece is None or (dropout and skipped(np.array([key], np.uint64), one(a[1]), one(b[1]), one(b[2]), dropout)[0]):
                continue
            if best is None or pieces.rank[piece] < best[0]:
                best = (pieces.rank[piece], k, piece)
        if best is None:
            break
        _, k, piece = best
        sym[k:k + 2] = [(piece, sym[k][1], sym[k + 1][2], 0)]
    out = []
    for s, _, _, c in sym:
        out += [s] if 0 <= s < len(pieces.bytes_of) else [int(pieces.byte[x]) for x in chr(0x2581 if c == 0x110000 else c).encode()]
    return out


def private(op, text):
    """(kind, normal form) of what ``op``'s detection finds in a text."""
    return [(k, n) for *_, pieces in op.mentions(text) for _, _, k, n, _ in pieces if k != "initial"]


def without_private(op, text, turn):
    """(text, entities) with surrogates, for the turns of the entities that drew again."""
    if not text:
        return text, 0
    spans = op.mentions(text)
    for a, b, k, n, sex in reversed([p for *_, pieces in spans for p in pieces]):
        text = text[:a] + op.written(k, text[a:b], op.surrogate(k, n, turn=turn.get((k, n), 0)), sex) + text[b:]
    return text, len(spans)
