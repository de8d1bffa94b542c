"""Plain versions of the operators, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter

import numpy as np

SPACED = re.compile("[^\x20\x09-\x0D]+")
PLAIN = re.compile("[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def quality(text):
    text = text or ""
    words = SPACED.findall(text)
    grams = [tuple(words[k:k + 5]) for k in range(len(words) - 4)]
    counts, repeated = Counter(grams), set()
    for k, gram in enumerate(grams):
        if counts[gram] > 1:
            repeated |= set(range(k, k + 5))
    lines = [x for x in text.split("\n") if SPACED.search(x)]
    n = len(words)
    return (n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), n < 10 or 100 * len(repeated) > 20 * n)


def leaks(text, items):
    words = PLAIN.findall(lower(text or ""))
    hit, found = set(), set()
    for item, other in items:
        own = PLAIN.findall(lower(other or ""))
        windows = {tuple(own[k:k + 10]) for k in range(len(own) - 9)} if len(own) >= 10 else {tuple(own)} if own else set()
        for window in windows:
            for k in range(len(words) - len(window) + 1):
                if tuple(words[k:k + len(window)]) == window:
                    hit |= set(range(k, k + len(window)))
                    if item is not None:
                        found.add(str(item))
    return (len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))


def shingles(text):
    words = SPACED.findall(lower(text or ""))
    return frozenset(tuple(words[k:k + 5]) for k in range(len(words) - 4)) if len(words) >= 5 else frozenset([tuple(words)] if words else [])


def near_components(rows):
    sets = {}
    for doc_id, text in rows:
        sets.setdefault(doc_id, shingles(text))
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                parent[max(find(i), find(j))] = min(find(i), find(j))
    return {i: (len(sets[i]), find(i)) for i in ids}


def repeats(rows, span=50):
    rows = sorted((i, (t or "").encode()) for i, t in rows)
    first, out = {}, {}
    for doc_id, text in rows:
        for k in range(len(text) - span + 1):
            first.setdefault(text[k:k + span], doc_id)
    for doc_id, text in rows:
        gone = np.zeros(len(text), bool)
        for k in range(len(text) - span + 1):
            if first[text[k:k + span]] < doc_id:
                gone[k:k + span] = True
        kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
        out[doc_id] = (len(text), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
    return out


def licenses(text):
    words = PLAIN.findall(lower(text or ""))
    places, labels = [], set()
    for phrase, label in ((("cc", "by"), "cc-by"), (("general", "public", "license"), "gpl"), (("all", "rights", "reserved"), "reserved")):
        for k in range(len(words) - len(phrase) + 1):
            if tuple(words[k:k + len(phrase)]) == phrase:
                places.append(k)
                labels.add(label)
    return (len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels)))


def conversation(turns):
    """Rows (turn, role, text) of one conversation."""
    turns = sorted(turns, key=lambda t: tuple((x is not None, x) for x in t))
    whole = "".join(f"{r or ''}\n{t or ''}\n" for _, r, t in turns)
    learned = "".join(t or "" for _, r, t in turns if r == "assistant")
    return (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(learned), hashlib.sha256(learned.encode()).hexdigest())


def vectors(rows, cosine=0.95):
    """Rows (vec_id, vector); n_links, component_id and kept of each, in their order."""
    units = []
    for _, v in rows:
        x = np.array([np.nan if c is None else c for c in v or []], float)
        some = len(x) and np.isfinite(x).all() and x.any()
        units.append(x / np.abs(x).max() / np.linalg.norm(x / np.abs(x).max()) if some else None)
    n = len(rows)
    near = [[i != j and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j]) and units[i] @ units[j] >= cosine for j in range(n)] for i in range(n)]
    out = []
    for i in range(n):
        seen, todo = {i}, [i]
        while todo:
            at = todo.pop()
            new = [j for j in range(n) if near[at][j] and j not in seen]
            seen.update(new)
            todo += new
        component = min((rows[j][0] for j in seen if rows[j][0] is not None), default=None)
        out.append((rows[i][0], sum(near[i]), component, rows[i][0] == component))
    return out


def trie(rows, order=None):
    """Rows (conv_id, turn, role, text) to the nodes of the rebuilt conversations' prefix trie."""
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((turn is not None, turn or 0, order(role, text) if order else 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(turns)] for c, turns in own.items()}
    nodes, ends = {}, {}
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        turns = own.get(c - c % 20, [])[:h] + own[c][h:]
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
        ends.setdefault(tuple(turns), []).append(c)
    children = Counter(n[:-1] for n in nodes if n)
    below = {n: [0, 0] for n in nodes}
    for n, members in nodes.items():
        saved = (len(members) - 1) * len(SPACED.findall(n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            below[n[:d]][0] += not children[n]
            below[n[:d]][1] += saved
    return [
        (min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], *below[n],
         hashlib.sha256(",".join(map(str, sorted(ends.get(n, [])))).encode()).hexdigest())
        for n, m in nodes.items()
    ]


def alignment(rows, a_encode, a_bytes, b_encode, b_bytes):
    """Rows (doc_id, text) to the alignment of the tokens of two tokenizers, in their order."""
    docs = []
    for doc_id, text in rows:
        a, b = (a_encode(" " + text), b_encode(text)) if text else ([], [])
        whole = (" " + text).encode() if text else b""
        if b"".join(map(a_bytes, a)) != whole or b"".join(map(b_bytes, b)) != whole:
            a, b = [], []
        spans = []
        for ids, raw in ((a, a_bytes), (b, b_bytes)):
            at, out = 0, []
            for i in ids:
                out.append((at, at + len(raw(i)), i))
                at += len(raw(i))
            spans.append(out)
        links = [(x[2], y[2]) for x in spans[0] for y in spans[1] if x[0] < y[1] and y[0] < x[1]]
        cuts = sorted({x[1] for x in spans[0]} & {y[1] for y in spans[1]})
        groups, low = [], 0
        for cut in cuts:
            groups.append("|".join(",".join(str(i) for s, e, i in side if low <= s and e <= cut) for side in spans))
            low = cut
        docs.append((doc_id, len(a), len(b), links, groups))
    counts = Counter(pair for *_, links, _ in docs for pair in set(links))
    best = {}
    for (a, _), n in counts.items():
        best[a] = max(best.get(a, 0), n)
    return [
        (doc_id, n_a, n_b, len(groups), len(links), sum(counts[p] == best[p[0]] for p in links), sum(counts[p] for p in links),
         hashlib.sha256(";".join(groups).encode()).hexdigest() if n_a else "")
        for doc_id, n_a, n_b, links, groups in docs
    ]
