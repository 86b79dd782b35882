"""Plain Python versions of the operators, and the odd rows that all of them must take."""

import re
from collections import Counter, defaultdict

import regex

WORD = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Names that the operators use inside.
CLASHES = (
    "key part copy place target kind chunk data digest words mark line text_key lines removed row label node size slice before "
    "start position stats score held_out cell page host template of_key of_id at first class"
).split()


def words(text):
    return WORD.findall((text or "").translate(FOLD))


def prose(seed, n):
    return " ".join(f"w{(seed * 7919 + i * 104729) % 5003}" for i in range(n))


def odd_rows():
    """Null, empty, blank, short, long, repeated and near-equal texts; null and repeated ids; null sources."""
    base = prose(1, 120)
    near = base.replace(base.split()[60], "changed")
    texts = [
        (1, base), (2, None), (3, ""), (4, " \t\n "), (5, base), (5, base), (6, near), (None, prose(2, 30)), (7, "one two"),
        (8, "one two"), (9, prose(3, 20000)), (10, "Été ÀÉ ñ 東京 \U0001f600 <|endoftext|> don't"), (12, base.upper()),
        (13, f"{prose(4, 40)}\n{prose(5, 30)}\n\nshort line"), (14, f"{prose(4, 40)}\n{prose(6, 30)}\nshort line"), (7, prose(8, 25)),
    ]
    return [(i, t, "en", None if n % 5 == 4 else f"s{n % 3}", None if t is None else len(t)) for n, (i, t) in enumerate(texts)]


def frame(spark, rows, clashes=True):
    """Rows as documents, with columns of names that the operators use inside."""
    if clashes:
        rows = [(*r, *["x"] * len(CLASHES)) for r in rows]
        return spark.createDataFrame(rows, COLUMNS + "".join(f", {c} string" for c in CLASHES))
    return spark.createDataFrame(rows, COLUMNS)


def shingle_set(text):
    w = words(text)
    if len(w) < 5:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4))


def groups(nodes, links):
    """Smallest node that links reach, for every node."""
    parent = {n: n for n in nodes}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similar_pairs(sets):
    """Pairs of positions whose sets have a Jaccard similarity of at least 0.75."""
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        common = Counter(j for g in s for j in holders[g])
        for j, k in common.items():
            if 100 * k >= 75 * (len(s) + len(sets[j]) - k):
                yield j, i
        for g in s:
            holders[g].append(i)


def near_duplicates(rows):
    """(doc_id, n_shingles, component_id) of (doc_id, text) rows."""
    sets = [shingle_set(t) for _, t in rows]
    group = groups(range(len(rows)), similar_pairs(sets))
    least = {}
    for i, g in group.items():
        ids = [x for x in (least.get(g), rows[i][0]) if x is not None]
        least[g] = min(ids) if ids else None
    return [(rows[i][0], len(sets[i]), least[group[i]]) for i in range(len(rows))]


def normal_line(line):
    return tuple(x for x in (regex.sub(r"[^\p{L}\p{N}]+", "", w.lower()) for w in line.split()) if x)


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        diagonal, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            diagonal, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, diagonal + (x != y))
    return row[-1]
