"""Rows that every operator must bear, and brute-force versions of the contracts."""

import random
from collections import Counter, defaultdict

LONG = " ".join(f"word{i % 977} other{i % 1013}" for i in range(30_000))

EDGES = [
    (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n ", None, "s", 4), (4, "one", "en", None, 3),
    (5, "one two", "en", "s", 7), (5, "one two", "en", "s", 7), (6, "ONE two", "xx", "s", 7),
    (None, "a text without an id that is long enough", "en", "s", None), (7, LONG, "en", "s", len(LONG)),
    (8, "中文字符 😀​ <s> ▁▁ x  y<|endoftext|> z", None, "s", None), (9, "aaaa " * 30, "en", "s", 150),
    (10, "A shared line of text\r\nnext\n  a SHARED line of text \n", "en", "s", 0),
    (11, "something else\nA shared line of text\nA shared line of text", "en", "s", 0),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def edge_docs(spark):
    """The edge rows, with extra columns that clash with result names."""
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(EDGES, SCHEMA)
    clashing = ("n_tokens", "kept", "component_id", "piece", "length", "band", "key", "id", "lost", "grade_")
    return docs.select("*", *[F.lit(7).alias(c) for c in clashing])


def by_row(df, *columns):
    return Counter(tuple(r[c] for c in columns) for r in df.collect())


def ascii_words(text):
    return (text or "").encode().lower().split()


def shingles(text, size):
    words = ascii_words(text)
    if not words:
        return frozenset()
    width = min(size, len(words))
    return frozenset(tuple(words[i : i + width]) for i in range(len(words) - width + 1))


def smallest_reachable(ids, links):
    """The smallest id reachable from each id."""
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def jaccard_components(texts, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    holders = defaultdict(list)
    for i, s in sets.items():
        for x in s:
            holders[x].append(i)
    common = Counter((a, b) for h in holders.values() for a in h for b in h if a < b)
    links = [p for p, n in common.items() if 100 * n >= percent * (len(sets[p[0]]) + len(sets[p[1]]) - n)]
    return {i: len(s) for i, s in sets.items()}, smallest_reachable(sets, links)


def kept_lines(docs, least=10):
    """{doc_id: (n_lines, n_dropped, kept text)} of unique, non-null ids."""
    def key(line):
        return line.encode().lower().strip(b" \t\n\x0b\x0c\r").decode()

    holders = defaultdict(set)
    for i, t in docs.items():
        for line in (t or "").split("\n"):
            holders[key(line)].add(i)
    out = {}
    for i, t in docs.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < least or min(holders[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


def near_copy_docs(groups=12, copies=70, words=90, seed=5):
    """Groups of edited copies, one group far larger than the others, a passage in all
    others, and plain texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(4000)]
    passage = [rng.choice(vocabulary) for _ in range(30)]
    out, next_id = {}, 0

    def add(words_):
        nonlocal next_id
        out[next_id] = " ".join(words_)
        next_id += 1

    for g in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(copies if g == 0 else rng.randint(2, 6)):
            copy = list(base)
            for _ in range(rng.randint(0, 6)):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            add(copy)
    for _ in range(90):
        add([rng.choice(vocabulary) for _ in range(40)] + passage)
    for n in range(1, 12):
        add([rng.choice(vocabulary) for _ in range(n)])
    ids = list(out)
    rng.shuffle(ids)
    return dict(zip(ids, out.values()))
