"""Plain versions of the contracts, on Python rows; the tests hold the queries against them."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

WHITE = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def shingle_set(text: str | None) -> frozenset:
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    k = min(5, len(words))
    return frozenset(tuple(words[i : i + k]) for i in range(len(words) - k + 1))


def near_duplicates(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int]]:
    """doc_id -> (n_shingles, component_id), all pairs that share a shingle compared."""
    sets = {d: shingle_set(t) for d, t in rows}
    holders = defaultdict(list)
    for d, s in sets.items():
        for x in s:
            holders[x].append(d)
    shared: Counter = Counter()
    for ds in holders.values():
        for i, a in enumerate(ds):
            for b in ds[i + 1 :]:
                shared[a, b] += 1
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for (a, b), both in shared.items():
        if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            parent[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def chats(rows: list[tuple]) -> dict[int, tuple]:
    """conv_id -> (n_turns, turns_sha256, loss_chars, loss_sha256); rows are (conv, turn, role, text)."""
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn, role, text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort(key=lambda x: x[0])
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[conv] = len(turns), sha("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), sha(loss)
    return out


def pieces(texts: list[str | None], path: str) -> list[tuple[list[int], str]]:
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = [model.encode(t or "") for t in texts]
    return [(ids, model.decode(ids)) for ids in found]


def quality(text: str | None) -> tuple[int, int, int, int, int, bool]:
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    marked = {j for i in range(len(words) - 7) if windows[tuple(words[i : i + 8])] > 1 for j in range(i, i + 8)}
    seen: set[str] = set()
    again = 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(marked) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(marked), failed


def line_dedup(rows: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, str]]:
    key = lambda line: line.strip(WHITE).translate(LOWER)
    docs = {d: (t or "").split("\n") for d, t in rows}
    holders = defaultdict(set)
    for d, lines in docs.items():
        for line in lines:
            holders[key(line)].add(d)
    out = {}
    for d, lines in docs.items():
        stay = [x for x in lines if len(key(x)) < 10 or min(holders[key(x)]) == d]
        out[d] = len(lines), len(lines) - len(stay), "\n".join(stay)
    return out


def targets(sizes: dict[str | None, int], weights=(5, 2, 1), limit=3) -> dict[str | None, float]:
    """Source -> target: water filling, the excess reshared until no target is above its limit."""
    order = sorted((s for s in sizes if s is not None)) + [s for s in sizes if s is None]
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, fixed, free = sum(sizes.values()), {}, set(order)
    while free:
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w > limit * sizes[s]]
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        for s in over:
            fixed[s] = limit * sizes[s]
            free.remove(s)
    return fixed


def held_out(doc_id: int) -> bool:
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def word_tokens(texts: list[str | None], path: str) -> list[tuple[list[int], str]]:
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.no_truncation()
    library.no_padding()
    found = [e.ids for e in library.encode_batch([t or "" for t in texts], add_special_tokens=False)]
    return [(ids, library.decode(ids, skip_special_tokens=False)) for ids in found]


def merkle(rows: list[tuple]) -> list[tuple]:
    """(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified) per row (doc_id, source, lang,
    n_chars, text), sorted; every level is built in full."""

    def field(x) -> str:
        return "-" if x is None else f"{len(str(x).encode())}:{x}"

    def leaf_of(row) -> str:
        return sha("".join(map(field, row)))

    def levels(nodes: list[str]) -> list[list[str]]:
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([sha("".join(out[-1][i : i + 3])) for i in range(0, len(out[-1]), 3)])
        return out

    by = defaultdict(list)
    for row in rows:
        by[row[1]].append(row)
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        by[s].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[s] = levels([leaf_of(r) for r in by[s]])
    upper = levels([trees[s][-1][0] for s in names])
    out = []
    for at, s in enumerate(names):
        for i, row in enumerate(by[s]):
            steps = []
            for tree, k in ((trees[s], i), (upper, at)):
                for nodes in tree[:-1]:
                    run = nodes[k - k % 3 : k - k % 3 + 3]
                    steps.append((run[: k % 3], run[k % 3 + 1 :]))
                    k //= 3
            hit = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = leaf_of((*row[:4], row[4].replace("\n", "") if hit and row[4] is not None else row[4]))
            for left, right in steps:
                node = sha("".join([*left, node, *right]))
            root = upper[-1][0]
            out.append((row[0], trees[s][0][i], trees[s][-1][0], root, sha("".join(x for a, b in steps for x in a + b)), node, node == root))
    return sorted(out, key=str)


def importance(rows: list[tuple[int | None, str | None]], target: list[str | None], longest: int = 1, buckets: int = 10000) -> list[tuple]:
    """(doc_id, n_features, weight, score, rank) per document, sorted."""

    def grams(text: str | None) -> tuple[int, list[str]]:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]

    place = lambda gram: zlib.crc32(gram.encode()) % buckets
    s = Counter(place(g) for _, t in rows for g in grams(t)[1])
    t = Counter(place(g) for x in target for g in grams(x)[1])
    all_s, all_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * float(all_s + buckets) / ((s[b] + 1) * float(all_t + buckets)))) for b in range(buckets)]
    out = []
    for doc_id, text in rows:
        n, found = grams(text)
        weight = sum(gain[place(g)] for g in found)
        h = int(sha(f"2024:{'' if doc_id is None else doc_id}")[:8], 16)
        out.append([doc_id, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n])
    fit = sorted((r for r in out if r[4] >= 20), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    drawn = {id(r): k + 1 for k, r in enumerate(fit[: 10 * len(fit) // 100])}
    return sorted(((*r[:4], drawn.get(id(r))) for r in out), key=str)


def robust_estimate(x, core: float, grid: int, least, inverse, starts: int = 3):
    """Mean and inverse covariance of the concentrated core with the least determinant, over the first
    estimates of the contract's method; `inverse` gives (inverse covariance, log determinant)."""
    import numpy as np

    median = np.median(x, axis=0)
    mad = 1.4826 * np.median(np.abs(x - median), axis=0)
    near = x[(np.abs(x - median) <= 2.5 * np.maximum(mad, least)).all(1)]
    first = [(median, np.diag(mad**2)), (x.mean(0), np.cov(x.T, bias=True)), (near.mean(0), np.cov(near.T, bias=True))]
    best = None
    for k, (mean, cov) in enumerate(first[:starts]):
        p, det = inverse(cov, 1.0)
        seen = []
        while True:
            gap = x - mean
            d = np.round(np.log1p(np.einsum("ki,ij,kj->k", gap, p, gap)) * grid)
            held = x[d <= np.ceil(np.quantile(d, core))]
            mean, (p, det) = held.mean(0), inverse(np.cov(held.T, bias=True), None)
            key = (len(held), *held.sum(0))
            if key in seen:
                break
            seen.append(key)
        if best is None or (round(det, 9), k) < best[0]:
            best = ((round(det, 9), k), mean, p)
    return best[1], best[2]
