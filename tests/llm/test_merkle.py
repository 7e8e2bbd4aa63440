import hashlib
import random
import zlib

from photonflow.llm import merkle


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def told(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def climb(nodes):
    """All levels of a list of nodes, up to the lone one."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([h(*last[i : i + 16]) for i in range(0, len(last), 16)])
    return levels


def siblings(levels, at):
    out = []
    for level in levels[:-1]:
        run = at // 16 * 16
        out.append(("".join(level[run:at]), "".join(level[at + 1 : run + 16])))
        at //= 16
    return out


def slow(docs):
    groups = {}
    for d in docs:
        k, source, lang, n, text = d
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text) if text is not None else None
        other = lower if zlib.crc32(str("" if k is None else k).encode()) % 5 == 0 else text
        groups.setdefault(source, []).append((k is not None, k or 0, h(*map(told, d)), h(*map(told, (k, source, lang, n, other)))))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: climb([r[2] for r in sorted(groups[s], key=lambda r: r[:3])]) for s in names}
    top = climb([trees[s][-1][0] for s in names])
    out = []
    for i, s in enumerate(names):
        for j, (has, k, leaf, other) in enumerate(sorted(groups[s], key=lambda r: r[:3])):
            path = siblings(trees[s], j) + siblings(top, i)
            end = other
            for a, b in path:
                end = h(a, end, b)
            root = top[-1][0]
            out.append((k if has else None, leaf, trees[s][-1][0], root, h(*(a + b for a, b in path)), end, end == root))
    return sorted(out, key=str)


def held(spark, docs):
    d = spark.createDataFrame([(*r, "x", 1) for r in docs], "doc_id long, source string, lang string, n_chars long, text string, node string, pos int")
    return sorted(map(tuple, merkle.tampered_manifest(d).collect()), key=str)


def test_manifest_equals_plain_trees(spark):
    rng = random.Random(5)
    docs = [(i, "big", "en", i % 7, f"Text {i} É") for i in range(300)]
    docs += [(1000 + i, f"s{i % 19}", None, None, rng.choice([None, "", "low", "UP", "ß" * 40_000])) for i in range(90)]
    docs += [(i, None, "fr", 1, "A") for i in range(2000, 2017)] + [(5000 + i, "sixteen", "", 0, "B") for i in range(16)] + [(6000, "lone", "de", 3, "Abc"), (7000, "", "x", 1, "C")]
    docs += [(None, "big", "en", 1, "N"), (None, "big", "en", 1, "N"), (7, "big", "en", 1, "again"), (8, "big", "en", 8 % 7, "Text 8 É")]
    rng.shuffle(docs)
    got, want = held(spark, docs), slow(docs)
    same = lambda rows: [r[:5] for r in rows]
    assert same(got) == same(want) and got == want
    assert {r[6] for r in got} == {True, False}


def test_small_tables(spark):
    for docs in ([(1, None, None, None, None)], [(1, "a", "b", 2, "Up"), (2, "b", "b", 2, "Up")], [(i, "a", "b", 1, "t") for i in range(257)]):
        assert held(spark, docs) == slow(docs)
    assert held(spark, []) == []


def test_manifest_takes_other_columns(spark):
    d = spark.createDataFrame([("b", "p", 1.5), ("a", "p", None)], "key string, part string, path double")
    rows = merkle.manifest(d, ["key", "path"], "part", "key").collect()
    leaves = {"a": h("1:a", "-"), "b": h("1:b", "3:1.5")}
    assert {r.key: r.leaf for r in rows} == leaves and {r.root for r in rows} == {h(leaves["a"], leaves["b"])}
