import random

from vecloom.llm.leak import leaks
from vecloom.llm.leak_text import Page, longest_run, near, passage_words

WORDS = "was of the with mearnstum cloudra feastall groombin hastwick plodrain shutterby wonclaim drastoon bellhouse karfunk zwölfton straßen moment dimmer into their bridgework naplosse tunnelfar quirndal".split()


def passage(seed, n=24):
    rng = random.Random(seed)
    return [rng.choice(WORDS) + rng.choice(["", "", "ea", "ow", "um"]) for _ in range(n)]


def run(text, words):
    return longest_run(Page(text), passage_words(" ".join(words)))


def test_runs_survive_what_scanning_does():
    p = passage(1)
    t = p[3:18]
    assert run("xx " + " ".join(t) + " yy", p) == 15
    assert run("xx " + " ".join(t).upper() + " yy", p) == 15
    assert run(". ".join(t) + "!", p) == 15
    hyphen = t[:4] + [t[4][:2] + "-\n" + t[4][2:]] + t[5:9] + [t[9][:3] + "\n" + t[9][3:]] + t[10:]
    assert run(" ".join(hyphen), p) == 15
    joined = t[:3] + [t[3] + t[4]] + t[5:8] + [t[8][:2] + " " + t[8][2:]] + t[9:]
    assert run(" ".join(joined), p) == 15
    misread = " ".join(t).replace("ea", "ca").replace("m", "rn").replace("l", "1").replace("u", "n")
    assert run(misread, p) == 15
    lines = [" ".join(t[i : i + 3]) for i in range(0, 15, 3)]
    assert run("\n".join(x for line in lines for x in (line, "some other column text")), p) == 15
    assert run("\n".join(line + "   some other column" for line in lines), p) == 15
    assert run("\r\n".join([*lines[:2], "ADVERT", "BUY NOW", "No. 1234", *lines[2:]]), p) == 15
    # the foot of one column, read on at the head of the next
    assert run("\n".join([*lines[3:], "other words here", *lines[:3]]), p) == 15


def test_broken_runs_do_not_count():
    p = passage(2, 30)
    pieces = [" ".join(p[i : i + 5]) for i in range(0, 30, 5)]
    assert run("a " + " foreign words between ".join(pieces) + " z", p) < 13
    assert run(" ".join(p[:12]) + " other", p) == 12
    assert run("", p) == 0 and run("  \n ", p) == 0
    assert near("nnstun", "nnstun") and not near("of", "in") and near("heastall", "heastal1".replace("1", "i"))


def test_leaks(spark):
    rng = random.Random(9)
    items = [(i, passage(100 + i, 30)) for i in range(6)]
    filler = lambda n: [rng.choice(WORDS) + "x" * rng.randrange(3) for _ in range(n)]
    docs, truth = [(0, None), (1, ""), (2, "\n \n")], set()
    for d in range(10, 60):
        item, words = items[d % 6]
        n = rng.choice([6, 10, 13, 14, 20, 30])
        at = rng.randrange(len(words) - n + 1)
        text = [*filler(40), "zzz", *words[at : at + n], "zzz", *filler(40)]
        docs.append((d, "\n".join(" ".join(text[i : i + 6]) for i in range(0, len(text), 6))))
        if n >= 13:
            truth.add((d, item))
    docs += [(70, docs[-1][1])] * 2
    truth |= {(70, item) for d, item in truth if d == 59}
    frame = spark.createDataFrame([(k, t, 1, "x") for k, t in docs], "doc_id bigint, text string, item int, at string")
    rows = [(i, " ".join(w), "p") for i, w in items] + [(90, None, "p"), (91, "too short", "p"), (92, "", "p")]
    item_frame = spark.createDataFrame(rows, "item_id bigint, passage string, doc string")
    got = [(r.doc, r.item) for r in leaks(frame, item_frame).collect()]
    assert len(got) == len(set(got)) and set(got) == truth
    assert leaks(frame.limit(0), item_frame).count() == 0
    assert leaks(frame, item_frame.limit(0)).count() == 0
    long = [(1, " ".join(filler(60_000) + items[0][1]))]
    assert [(r.doc, r.item) for r in leaks(spark.createDataFrame(long, "doc_id bigint, text string"), item_frame).collect()] == [(1, 0)]


def test_items_with_several_passages(spark):
    a, b = passage(201, 20), passage(202, 25)
    docs = spark.createDataFrame([(1, "xx " + " ".join(a)), (2, "yy " + " ".join(b)), (3, "zz " + " ".join(a[:10] + b[:10]))], "doc_id bigint, text string")
    for order in ([a, b], [b, a]):
        items = spark.createDataFrame([(7, " ".join(w)) for w in order], "item_id bigint, passage string")
        assert sorted((r.doc, r.item) for r in leaks(docs, items).collect()) == [(1, 7), (2, 7)]
