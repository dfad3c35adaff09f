"""Near copies by shingle similarity, against brute force over all pairs."""

from __future__ import annotations

import random

from framelake.llm import shingles, simhash
from test_operators import sentence


def shingle_set(text, width=5):
    words = (text or "").lower().split()
    return {" ".join(words)} if len(words) <= width else {" ".join(words[i : i + width]) for i in range(len(words) - width + 1)}


def brute(texts, similarity=0.8):
    sets = {i: shingle_set(t) for i, t in texts.items()}
    root = {i: i for i in sets}
    for i in sorted(sets):
        for j in sorted(sets):
            if j < i and len(sets[i] & sets[j]) / len(sets[i] | sets[j]) >= similarity:
                low, high = sorted((root[i], root[j]))
                root = {k: low if r == high else r for k, r in root.items()}
    return root


def near_texts():
    """Copies with a few changed words, on both sides of similarity 0.8."""
    rng = random.Random(4)
    texts = []
    for _ in range(30):
        words = sentence(rng, rng.randint(20, 150)).split()
        texts.append(" ".join(words))
        for share in (0.01, 0.02, 0.03, 0.05):
            texts.append(" ".join("changed" + str(rng.random()) if rng.random() < share else w for w in words))
    rng.shuffle(texts)
    return dict(enumerate(texts))


def test_all_links_at_the_threshold(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = simhash.near_duplicates(docs, width=5, radius=5, similarity=0.8).collect()
    assert {r["doc_id"]: r["component_id"] for r in got} == brute(texts)


def test_no_link_below_the_threshold(spark):
    """The same words in another order have equal word fingerprints and few common shingles."""
    rng = random.Random(6)
    words = sorted(set(sentence(rng, 200).split()))
    shuffled = rng.sample(words, len(words))
    texts = {1: " ".join(words), 2: " ".join(shuffled), 3: " ".join(shuffled[:-1]), 4: " ".join(words), 5: "", 6: None}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    kept = simhash.keep_one(docs, width=5, radius=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 2, 5]


def test_groups_in_blocks(spark):
    """A group dealt into many pairs of blocks keeps every link and makes none."""
    rng = random.Random(7)
    words = sentence(rng, 80).split()
    texts = {i: " ".join("x" + str(i) if k in (i % 80, 3 * i % 80) else w for k, w in enumerate(words)) for i in range(60)}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    sets = {i: shingles.shingle_set(t) for i, t in texts.items()}
    rows = [(simhash._signed(shingles.set_key(s)), i, len(s), [simhash._signed(int(b)) for b in shingles.bands(s)]) for i, s in sets.items()]
    classes = spark.createDataFrame(rows, "fp long, rep long, n long, bands array<long>")
    names = {r[0]: r[1] for r in rows}
    root = {i: i for i in texts}
    for r in shingles.links(docs, classes, 5, 0.8, block=700).collect():
        low, high = sorted((root[names[r["a"]]], root[names[r["b"]]]))
        root = {k: low if x == high else x for k, x in root.items()}
    assert root == brute(texts)


def test_fingerprints_propose_candidates(spark, monkeypatch):
    """Without any band, what lies within the fingerprints' radius is still found and confirmed,
    and equal fingerprints of other shingles are not."""
    rng = random.Random(12)
    words = [sentence(rng, 400).split() for _ in range(6)]
    texts = {}
    for i, w in enumerate(words):
        texts[2 * i] = " ".join(w)
        texts[2 * i + 1] = " ".join([*w[:-1], "changed"])
    # a passage that is there often has the votes, whatever follows it
    texts[20], texts[21] = " ".join(words[0][:31] * 60), " ".join(words[0][:31] * 60 + words[1])
    texts[30], texts[31] = "", None
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    prints = {i: simhash.fingerprint(t) for i, t in texts.items()}
    near = [i for i in range(0, 12, 2) if (prints[i] ^ prints[i + 1]).bit_count() <= 2]
    assert len(near) >= 3 and (prints[20] ^ prints[21]).bit_count() <= 2
    monkeypatch.setattr(shingles, "bands", lambda found: found[:0])
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(docs, width=5, radius=2, similarity=0.8).collect()}
    assert got == {i: i - 1 if i - 1 in near else 30 if i == 31 else i for i in texts}


def test_print_links_join_all_sets(spark):
    """Sets with one fingerprint, and with fingerprints two bits apart, are connected; others are not."""
    rows = [(0b0000, 1), (0b0000, 2), (0b0011, 3), (0b1111, 4), (0b0000, 1), (-1, 5), (-1, 6), (0b1111 << 20, 7), (0b0011, 6)]
    found = simhash.print_links(spark.createDataFrame(rows, "print long, fp long"), 2).collect()
    root = {i: i for i in range(1, 8)}
    for r in found:
        low, high = sorted((root[r["a"]], root[r["b"]]))
        root = {k: low if v == high else v for k, v in root.items()}
    assert root == {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 7}
