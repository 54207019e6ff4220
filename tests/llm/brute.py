"""Plain Python versions of the operators, for small inputs."""

import hashlib
import math
import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower_ascii(t):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)


def shingles(text, k=5):
    w = WORD.findall(lower_ascii(text or ""))
    if not w:
        return frozenset()
    k = min(k, len(w))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1))


def jaccard_components(rows, percent=80):
    """rows: (doc_id, text) -> sorted (doc_id, n, component)."""
    sets = [shingles(t) for _, t in rows]
    by_set = {}
    for i, s in enumerate(sets):
        by_set.setdefault(s, []).append(i)
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    reps = [v[0] for s, v in by_set.items() if s]
    for s, v in by_set.items():
        if s:
            for i in v[1:]:
                parent[find(i)] = find(v[0])
    index = {}
    for i in reps:
        for t in sets[i]:
            index.setdefault(t, []).append(i)
    for i in reps:
        seen = {}
        for t in sets[i]:
            for j in index[t]:
                if j < i:
                    seen[j] = seen.get(j, 0) + 1
        for j, both in seen.items():
            if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        r = find(i)
        least[r] = d if r not in least else min(d, least[r])
    return sorted((d, len(sets[i]), least[find(i)]) for i, (d, _) in enumerate(rows))


def window_dedup(rows, k=50):
    """rows: (doc_id, text) -> sorted (doc_id, n_words, n_removed, kept text)."""
    first = {}
    split = [WORD.findall(t or "") for _, t in rows]
    for (d, _), w in zip(rows, split):
        for i in range(len(w) - k + 1):
            key = tuple(w[i : i + k])
            first[key] = min(d, first.get(key, d))
    out = []
    for (d, _), w in zip(rows, split):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i : i + k])] < d:
                gone.update(range(i, i + k))
        out.append((d, len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return sorted(out)


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def line_dedup(rows, edits=2, least=20, near=None):
    """rows: (doc_id, text) -> sorted (doc_id, n_lines, n_removed, n_near, kept text)."""
    near = near or (lambda a, b: edit_distance(a, b) <= edits)
    first = {}
    for d, t in rows:
        for i, line in enumerate((t or "").split("\n")):
            if WORD.search(line):
                first[line] = min((d, i), first.get(line, (d, i)))
    by_len = {}
    for line in first:
        by_len.setdefault(len(line), []).append(line)
    late = set()
    for a in first:
        if len(a) < least:
            continue
        for n in range(max(least, len(a) - edits), len(a) + edits + 1):
            for b in by_len.get(n, ()):
                if a != b and first[b] < first[a] and near(a, b):
                    late.add(a)
    out = []
    for d, t in rows:
        split = (t or "").split("\n")
        worded = [i for i, x in enumerate(split) if WORD.search(x)]
        gone = {i for i in worded if first[split[i]] != (d, i) or split[i] in late}
        n_near = sum(1 for i in gone if first[split[i]] == (d, i))
        out.append((d, len(worded), len(gone), n_near, "\n".join(x for i, x in enumerate(split) if i not in gone)))
    return sorted(out)


def unit(seed, doc_id):
    return int(hashlib.md5(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:13], 16) / 2.0**52


def water_level(caps, weights, total):
    """min(cap, weight * level) summing to total, by raising the level past one cap after the other."""
    order = sorted(range(len(caps)), key=lambda i: caps[i] / weights[i])
    left, open_w, level = total, sum(weights), None
    for i in order:
        if left / open_w <= caps[i] / weights[i]:
            level = left / open_w
            break
        left, open_w = left - caps[i], open_w - weights[i]
    return [c if level is None else min(c, w * level) for c, w in zip(caps, weights)]


def mix(rows, weights=(5, 2, 1), share=1.5, most=2.0):
    """rows: (doc_id, text, source) -> copies of each row, in order; doc_ids are distinct, texts have words."""
    size = [len(WORD.findall(t or "")) for _, t, _ in rows]
    sources = sorted({s for *_, s in rows}, key=lambda s: (s is None, s or ""))
    by = {s: [i for i, r in enumerate(rows) if r[2] == s] for s in sources}
    total = {s: sum(size[i] for i in by[s]) for s in sources}
    targets = water_level([most * total[s] for s in sources], [weights[k % len(weights)] for k in range(len(sources))], share * sum(total.values()))
    copies = [0] * len(rows)
    for s, target in zip(sources, targets):
        classes = sorted({size[i].bit_length() - 1 for i in by[s] if size[i]})
        words = {c: sum(size[i] for i in by[s] if size[i] and size[i].bit_length() - 1 == c) for c in classes}
        expected = dict(zip(classes, (x / words[c] for c, x in zip(classes, water_level([most * words[c] for c in classes], [2 ** (c / 4) * words[c] for c in classes], target)))))
        certain = {c: math.floor(e + 1e-9) for c, e in expected.items()}
        p = {c: max(0.0, expected[c] - certain[c]) for c in classes}
        rest = target - sum(certain[c] * words[c] for c in classes)
        drawn = []
        for i in by[s]:
            if size[i]:
                c = size[i].bit_length() - 1
                copies[i] = certain[c]
                if p[c] > 1e-9:
                    u = unit("mix", rows[i][0])
                    drawn.append((u / (1 - u) / (p[c] / (1 - p[c])), rows[i][0], size[i], i))
        before = 0
        for _, _, n, i in sorted(drawn):
            if before + n / 2 <= rest:
                copies[i] += 1
            before += n
    return copies


def contaminated(text, items, n=10):
    """Whether a text holds an n-word window of an item (or a shorter item whole)."""
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    w = word.findall(lower_ascii(text or ""))
    for item in items:
        k = word.findall(lower_ascii(item or ""))
        m = min(n, len(k))
        grams = {tuple(k[i : i + m]) for i in range(len(k) - m + 1)} if m else set()
        if any(tuple(w[i : i + m]) in grams for i in range(len(w) - m + 1) if m):
            return True
    return False


def interleave(rows, shards):
    """rows: (doc_id, text, source), distinct ids or equal rows -> sorted (doc_id, size, shard, slot)."""
    by = {}
    for d, t, s in rows:
        raw = (t or "").encode()
        by.setdefault(s, []).append((unit("shards", d), d, zlib.crc32(raw), len(raw) + 8))
    ranked = []
    for s, mine in by.items():
        for r, (_, d, _, size) in enumerate(sorted(mine)):
            ranked.append(((r + 0.5) / len(mine), s is None, s or "", r, d, size))
    ranked.sort()
    n = len(ranked)
    return sorted((d, size, at * shards // n, at - -(-(at * shards // n) * n // shards)) for at, (*_, d, size) in enumerate(ranked))
