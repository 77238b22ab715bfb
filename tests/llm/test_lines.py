"""Content-defined chunks of lines against a brute-force version."""

import hashlib
import random
import re

import xxhash

from pairlight.llm import lines, queries

M = (1 << 64) - 1


def signed(v):
    return v - (1 << 64) if v >> 63 else v


def slow_chunks(text, long_words=20):
    units = []
    paragraphs = text.split("\n")
    for k, p in enumerate(paragraphs):
        parts = [x for x in re.split(r"(?<=[.!?] )", p) if x] or [""]
        for i, x in enumerate(parts):
            end = "\n" if i == len(parts) - 1 and k < len(paragraphs) - 1 else ""
            if x + end:
                units.append((x + end, xxhash.xxh64_intdigest(x.rstrip(" ").encode(), 42), i == 0, p.count(" ") + 1 >= long_words))
    n = len(units)
    hard = [i == n - 1 or (units[i + 1][2] and (units[i][3] or units[i + 1][3])) for i in range(n)]
    turned = lambda h: ((h << 1) | (h >> 63)) & M
    roll = [u[1] if i == 0 or hard[i - 1] else turned(units[i - 1][1]) ^ u[1] for i, u in enumerate(units)]
    out, now = [], []
    for i in range(n):
        now.append(units[i][0])
        soft = 1 <= i < n - 1 and not any(hard[i - 1 : i + 2]) and signed(roll[i]) < min(signed(roll[i - 1]), signed(roll[i + 1]))
        if hard[i] or soft:
            out.append(now)
            now = []
    return out


def slow(docs, min_words=50):
    """Rows (doc_id, text) with distinct ids, null last."""
    seen, out = set(), {}
    for d, text in sorted(docs, key=lambda r: (r[0] is None, r[0])):
        chunks, kept, gone = slow_chunks(text or ""), [], 0
        for c in chunks:
            bare = "".join(c).rstrip(" \n")
            if len(c) > 1 or bare.count(" ") + 1 >= min_words:
                if bare in seen:
                    gone += 1
                    continue
                seen.add(bare)
            kept += c
        out[d] = ("".join(kept) if text is not None else None, sum(map(len, chunks)), len(chunks), gone)
    return out


def corpus():
    rnd = random.Random(4)
    sentence = lambda: " ".join(rnd.choice(["aa", "b", "ccc", "dé"]) + str(rnd.randint(0, 99)) for _ in range(rnd.randint(1, 12))) + rnd.choice([". ", "! ", "? ", ".\n", "\n", ""])
    passage = "".join(sentence() for _ in range(12))
    docs = [(i, "".join(sentence() for _ in range(rnd.randint(0, 30))) + (passage if i % 3 == 0 else "") + "".join(sentence() for _ in range(5))) for i in range(40)]
    docs += [(40, docs[7][1]), (41, docs[7][1] + "\n"), (42, None), (43, ""), (44, "\n\n\n"), (45, "a. b. a. b. \na. b. a. b. "), (46, "x y\n" * 500), (47, ". . ! ? "), (None, docs[7][1]), (48, "w " * 60), (49, "w " * 60)]
    return docs


def test_chunks_are_the_text_and_survive_shifts():
    rnd = random.Random(9)
    text = "".join(f"Line {rnd.random()} here.\n" for _ in range(60))
    whole = ["".join(c) for c in slow_chunks(text)]
    moved = ["".join(c) for c in slow_chunks("New first line.\nAnd a second.\n" + text)]
    assert "".join(whole) == text and len(set(whole) & set(moved)) >= len(whole) - 2 and all(c.count("\n") > 1 for c in whole)


def test_dedup(spark):
    docs = corpus()
    df = spark.createDataFrame([(d, t, "e", 1) for d, t in docs], "doc_id long, text string, n_lines string, owner int")
    made = lines.dedup_lines(df)
    got = {r.doc_id: (r.text_kept, r.n_lines, r.n_chunks, r.n_removed) for r in made.collect()}
    assert got == slow(docs) and sum(v[3] for v in got.values()) > 20
    assert made.columns[:3] == ["doc_id", "text", "owner"]
    assert lines.dedup_lines(df.limit(0)).count() == 0


def test_repeated_ids_keep_their_chunks(spark):
    text = "One here. Two here. Three here. "
    df = spark.createDataFrame([(1, text), (1, text), (1, text + "Four. "), (2, text)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_removed, r.text_kept) for r in lines.dedup_lines(df).collect())
    assert got == sorted([(1, 0, text), (1, 0, text), (1, 0, text + "Four. "), (2, 1, "")])


def test_op8_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    want = slow(docs)
    for r in queries.op8_line_dedup(spark, sf).collect():
        kept, n_lines, n_chunks, gone = want.pop(r.doc_id)
        assert (r.n_lines, r.n_chunks, r.n_removed, r.kept_chars, r.kept_sha256) == (n_lines, n_chunks, gone, len(kept), hashlib.sha256(kept.encode()).hexdigest())
    assert not want


def repeated_words(rows, n=50):
    """Of each (doc_id, text), the words in windows of n words that an earlier document has, or this one before the window."""
    seen, out = {}, {}
    for d, text in sorted(rows):
        words, mark = text.split(), set()
        for i in range(len(words) - n + 1):
            at = seen.setdefault(tuple(words[i : i + n]), (d, i))
            if at[0] != d or i >= at[1] + n:
                mark.update(range(i, i + n))
        out[d] = mark
    return out


def without(text, gone):
    tokens = re.findall(r"\S+\s*", text)
    return re.match(r"\s*", text)[0] + "".join(t for i, t in enumerate(tokens) if i not in gone)


def slow_own(docs):
    repeated, seen, out = repeated_words(docs), set(), {}
    for d, text in sorted(docs):
        gone, at = set(repeated[d]), 0
        for c in slow_chunks(text):
            bare, n = "".join(c).rstrip(" \n"), len("".join(c).split())
            if len(c) > 1 or bare.count(" ") + 1 >= 50:
                if bare in seen:
                    gone |= set(range(at, at + n))
                seen.add(bare)
            at += n
        out[d] = gone
    return out


def test_passages_of_fifty_words(spark):
    """Ends of a shared passage go too, also inside lines; the first place of each stays."""
    rnd = random.Random(11)
    word = lambda: f"w{rnd.randint(0, 10**6)}"
    prose = lambda n: " ".join(word() + ("." if rnd.random() < 0.1 else "") for _ in range(n))
    shared, long = prose(90), " ".join(word() for _ in range(70))
    docs = [(1, prose(40) + " " + shared + " " + prose(40)), (2, prose(33) + " " + shared + " " + prose(10)), (3, "\n " + prose(30) + " " + long + " " + prose(5)),
            (4, prose(7) + "\t" + long + "\n" + prose(60)), (5, "x " * 300), (6, prose(20) + "\n" + shared[:200] + "\n" + long + " " + shared), (7, long), (8, ""), (9, prose(49))]
    df = spark.createDataFrame([*docs, (10, None)], "doc_id long, text string")
    made = {r.doc_id: r for r in lines.dedup_lines(df, passage_words=50).collect()}
    gone, repeated = slow_own(docs), repeated_words(docs)
    for d, text in docs:
        want = without(text, gone[d]) if repeated[d] else made[d].text_kept
        assert made[d].text_own == want, d
        assert made[d].n_passages == sum(i - 1 not in repeated[d] for i in repeated[d])
    assert made[10].text_own is None and len(made[2].text_own.split()) == 43 and made[7].text_own == ""
    assert not any(repeated_words([(d, made[d].text_own) for d, _ in docs]).values())


def test_op8_query_has_no_repeated_passages(spark):
    sf = "/root/testdata/sf0.001"
    docs = [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    gone, repeated, kept = slow_own(docs), repeated_words(docs), slow(docs)
    want = {d: without(text, gone[d]) if repeated[d] else kept[d][0] for d, text in docs}
    got = {r.doc_id: (r.own_chars, r.own_sha256) for r in queries.op8_line_dedup(spark, sf).collect()}
    assert got == {d: (len(t), hashlib.sha256(t.encode()).hexdigest()) for d, t in want.items()}


def marks(spark, docs, n=50):
    """Of each (doc_id, text), the words in the windows that `passages` finds."""
    df = spark.createDataFrame([(d, d, t) for d, t in docs], "owner long, version long, text string")
    found = {r.owner: r.starts for r in lines.passages(df, n).collect()}
    assert all(s == sorted(set(s)) for s in found.values())
    return {d: {i - 1 + k for i in found.get(d, []) for k in range(n)} for d, _ in docs}


def test_passages_of_texts_that_repeat_themselves(spark):
    rnd = random.Random(23)
    pool = [" ".join(f"w{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(20, 130))) for _ in range(6)] + ["x " * 70 + "y", "a b c " * 40, "z " * 130]
    docs = [(d, " ".join(rnd.choice(pool) if rnd.random() < 0.7 else f"own{rnd.randint(0, 10**6)}" for _ in range(rnd.randint(1, 9)))) for d in range(60)]
    want = repeated_words(docs)
    assert marks(spark, docs) == want and sum(map(len, want.values())) > 5000


def test_copies_are_not_cut_into_windows(spark, monkeypatch):
    """Runs of equal words go as a whole: only the ends of a shared passage, and where one copy differs, are compared window by window."""
    rnd = random.Random(29)
    prose = lambda n: [f"w{rnd.randint(0, 10**6)}" for _ in range(n)]
    shared = prose(1500)
    docs = [(d, " ".join(prose(20) + shared + prose(20))) for d in range(12)] + [(12, " ".join(shared[:700] + prose(1) + shared[701:]))]
    written, cut = [], lines.cut

    def seen(df):
        made = cut(df)
        if "d" in made.columns:
            written.append(made.count())
        return made

    monkeypatch.setattr(lines, "cut", seen)
    assert marks(spark, docs) == repeated_words(docs)
    assert len(written) == 1 and written[0] < 6000, written
