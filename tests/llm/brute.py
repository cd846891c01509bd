"""Plain versions of the operators, written for small inputs."""

import re

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def base_quality(text):
    text = text or ""
    words = WORDS.findall(text)
    lines, seen, dup = text.split("\n"), set(), 0
    for x in lines:
        if WORDS.search(x):
            dup += x in seen
            seen.add(x)
    count, covered = {}, set()
    grams = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    for g in grams:
        count[g] = count.get(g, 0) + 1
    for i, g in enumerate(grams):
        if count[g] > 1:
            covered.update(range(i, i + 8))
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(covered)


def shingles(text, n):
    w = WORDS.findall(lowered(text))
    return {tuple(w)} if 0 < len(w) < n else {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def near_duplicates(rows, n):
    """{doc_id: (set size, component)} of (doc_id, text) rows, by all pairs."""
    sets = {d: shingles(t, n) for d, t in rows}
    parent = {d: d for d in sets}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    ids = sorted(d for d in sets if sets[d])
    ids.sort(key=lambda d: len(sets[d]))
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if 100 * len(x) < 80 * len(y):
                break
            both = len(x & y)
            if 100 * both >= 80 * (len(x) + len(y) - both):
                ra, rb = find(a), find(b)
                parent[max(ra, rb)] = min(ra, rb)
    return {d: (len(sets[d]), find(d)) for d in sets}


PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))


def base_licenses(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text))
    places, labels = [], set()
    for phrase, label in PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i : i + len(p)] == p:
                places.append(i)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def license_labels(text, templates, share=0.8):
    """Labels of templates in a text: short ones word for word, long ones by a longest common subsequence within 1.3 of their length."""
    words, out = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered(text)), set()
    line = " " + " ".join(words) + " "
    for phrase, label, keys in templates:
        own = phrase.split()
        if len(own) < 10:
            if f" {phrase} " in line:
                out.add(label)
            continue
        if len(set(own) - set(words)) > 0.2 * len(own) or not all(f" {k} " in line for k in keys):
            continue
        for start in range(0, max(1, len(words) - len(own) // 2), 3):
            row = [0] * (len(own) + 1)
            for w in words[start : start + len(own) + max(3, len(own) // 10)]:
                new = row[:]
                for i, x in enumerate(own):
                    new[i + 1] = row[i] + 1 if x == w else max(row[i + 1], new[i])
                row = new
            if row[-1] >= share * len(own):
                out.add(label)
                break
    return out


PII = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def base_pii(text):
    """(kind, start, end) by kind, then start."""
    text, out = text or "", []
    for kind, pattern in PII.items():
        for m in pattern.finditer(text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = {
                "email": lambda: True,
                "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")),
                "card": lambda: 13 <= len(digits) <= 19 and luhn(digits),
                "phone": lambda: 9 <= len(digits) <= 15,
            }[kind]()
            if ok:
                out.append((kind, *m.span()))
    return out


SECRETS = {
    "assign": re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    "access": re.compile(r"AKIA[A-Z0-9]+"),
    "hex": re.compile(r"[0-9a-f]+"),
}


def base_secrets(text):
    """(kind, start, end) by start, then kind."""
    out = []
    for kind, pattern in SECRETS.items():
        for m in pattern.finditer(text or ""):
            if len(m[2] if kind == "assign" else m[0]) >= {"assign": 6, "access": 20, "hex": 24}[kind]:
                out.append((kind, *m.span()))
    return sorted(out, key=lambda x: (x[1], list(SECRETS).index(x[0])))


def lower_case_words(text):
    return {w for w in re.findall(r"[0-9A-Za-z\x80-\U0010FFFF]+", text) if not w[0].isupper()}


def template(text, common, units):
    """(NUMBER, NAME, UNIT or word; value) of each template token."""
    out, end = [], None
    for m in re.finditer(r"[0-9A-Za-z\x80-\U0010FFFF]+", text):
        w, low = m[0], lowered(m[0])
        kind = "NUMBER" if w.isdigit() else "UNIT" if low in units else "NAME" if w[0].isupper() and low not in common else "word"
        gap = text[end : m.start()] if end is not None else ""
        stopped = len(gap) > 1 and re.search("[.!?:;]", gap) or "\n" in gap
        if out and kind != "word" and out[-1][0] == kind and not stopped:
            out[-1] = (kind, out[-1][1] + (low,))
        else:
            out.append((kind, (low,)))
        end = m.end()
    return out


def manifest(rows):
    """{doc_id: (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)} of (doc_id, source, lang, n_chars, text) rows of different ids."""
    import hashlib
    import zlib

    joined = lambda *parts: hashlib.sha256("".join(parts).encode()).hexdigest()
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def levels(nodes):
        made = [nodes]
        while len(nodes) > 1:
            nodes = [joined(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
            made.append(nodes)
        return made

    by = {}
    for r in rows:
        by.setdefault(r[1], []).append(r)
    trees = {s: levels([joined(*map(field, r)) for r in sorted(x, key=lambda r: r[0])]) for s, x in by.items()}
    order = sorted(trees, key=lambda s: (s is not None, (s or "").encode()))
    top = levels([trees[s][-1][0] for s in order])
    out = {}
    for s, x in by.items():
        for p, r in enumerate(sorted(x, key=lambda r: r[0])):
            tampered = zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4] is not None
            h, siblings = joined(*map(field, (*r[:4], lowered(r[4]) if tampered else r[4]))), []
            for tree, q in ((trees[s], p), (top, order.index(s))):
                for level in tree[:-1]:
                    a = q // 16 * 16
                    run = level[a : a + 16]
                    siblings += run[: q - a] + run[q - a + 1 :]
                    h = joined(*run[: q - a], h, *run[q - a + 1 :])
                    q //= 16
            out[r[0]] = (r[0], trees[s][0][p], trees[s][-1][0], top[-1][0], joined(*siblings), h, h == top[-1][0])
    return out
