import random

import numpy as np
from xxhash import xxh64_intdigest

from millrace.llm import simhash
from millrace.llm.copies import keep_one_of_each
from millrace.llm.simhash import BKTree, fingerprint, fingerprint_links, near_duplicates, shard_links


def plain_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        w = w.replace(c, " ")
    w = [x for x in w.split(" ") if x]
    if not w:
        return 0
    h = [xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(ids, fps):
    lab = list(range(len(ids)))
    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = lab[i], lab[j]
                lab = [b if x == a else x for x in lab]
    return {i: min(ids[k] for k in range(len(ids)) if lab[k] == lab[n]) for n, i in enumerate(ids)}


TEXTS = [None, "", " \t\n", "One", "one", "a b", "A\tB", "a b c", "É é É", "x" * 100_000, "the quick brown fox jumps over", "THE quick\x0bbrown fox jumps over", "a b c d " * 3000]


def test_fingerprint():
    for t in TEXTS:
        assert fingerprint(t) == plain_fingerprint(t)
    assert fingerprint("one") == fingerprint("ONE") != fingerprint("two")


def test_tree():
    rng = random.Random(3)
    members = [rng.getrandbits(64) for _ in range(50)]
    members += [m ^ 1 << rng.randrange(64) for m in members[:20]] + [m ^ 3 for m in members[:5]]
    members = sorted(set(members))
    for radius in (0, 2, 9):
        who, node = BKTree(np.array(members, np.uint64)).within(np.array(members, np.uint64), radius)
        assert sorted(zip(who.tolist(), node.tolist(), strict=True)) == [(i, j) for i, a in enumerate(members) for j, b in enumerate(members) if (a ^ b).bit_count() <= radius]
    assert len(shard_links(np.arange(5, dtype=np.uint64))) == 4
    assert not shard_links(np.zeros(0, np.uint64)) and BKTree(np.zeros(0, np.uint64)).within(np.zeros(3, np.uint64), 2)[0].size == 0


def test_trees_prune():
    members = np.random.default_rng(1).integers(0, 1 << 63, simhash.SHARD, np.uint64)
    tree = BKTree(members)
    tree.within(members[:2000], 2)
    assert tree.met < 0.02 * 2000 * len(members)


def test_documents(sp):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(100, TEXTS[10]), (100, TEXTS[10]), (101, None)]
    got = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in near_duplicates(sp.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = components([i for i, _ in rows], [plain_fingerprint(t) for _, t in rows])
    assert got == {(i, plain_fingerprint(t)): want[i] for i, t in rows}


def test_crowded_shards(sp):
    """Shards dealt again by sub-bands lose no link: a chain, a star and far neighbours."""
    rng = random.Random(5)
    seeds = [rng.getrandbits(64) for _ in range(6)]
    fps = set(seeds)
    for s in seeds[:3]:
        x = s
        for _ in range(40):
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
            fps.add(x)
        fps |= {s ^ 1 << b for b in range(0, 64, 5)}
    fps = sorted(fps)
    frame = sp.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp long")
    for shard in (2, 20, 4096):
        links = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in fingerprint_links(frame, shard).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        lab = {f: f for f in fps}
        for a, b in links:
            x, y = lab[a], lab[b]
            lab = {k: min(x, y) if v in (x, y) else v for k, v in lab.items()}
        assert lab == components(fps, fps)


def test_keep_one(sp):
    d = sp.createDataFrame([(3, "a b c d", 1), (2, "a b c d", 2), (2, "a b c d", 2), (9, "other words are here", 3), (None, "q", 4)], "doc_id long, text string, fp int")
    kept = keep_one_of_each(d)
    assert kept.columns == d.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 2, 9]
    assert near_duplicates(d.where("false")).count() == 0
    assert simhash.RADIUS == 2
