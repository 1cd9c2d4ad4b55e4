import random
from collections import Counter

import pytest

from colonnade.llm.truncation import Rules, _words, evidence, find_truncated, share_by_source, tail

RNG = random.Random(8)
SENTENCES = ["I only wanted to polish the lantern.", "Where is the conductor?", "We leave for the harbour tomorrow.", "The magistrate says the kettle is empty.", "She borrowed the blanket near the chapel.", "Thank you.", "Come here!"]


def text(n, end="\n", lines=None):
    said = lines or [RNG.choice(SENTENCES) for _ in range(n)]
    return "\n".join(f"{k}\n00:00:{k % 60:02d},000 --> 00:00:{k % 60:02d},900\n{x}\n" for k, x in enumerate(said, 1)).rstrip("\n") + end


@pytest.mark.parametrize(
    "end, state, final",
    [
        ("\n\n12", "header", "#"),
        ("\n\n12\n", "header", "#"),
        ("\n\n12\n00:00:0", "header", "#\n00:00:0"),
        ("\n\n12\n00:00:01,000 --> 00:0...", "header", "#\n00:00:00,000 --> 00:0"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000", "header", "#\n00:00:00,000 --> 00:00:00,000"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\n<i>I told you.", "broken", "you"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\n[door cre", "broken", "cre"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\n♪ hey ho", "broken", "ho"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\nListen,", "broken", "listen"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\nFifty.", "whole", "fifty"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\n<i>I told you.</i>", "whole", "you"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\n[door creaks]\n", "whole", "creaks"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\nNo —", "whole", "no"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\nI told", "title", "told"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\n1984", "title", "1984"),
        ("\n\n12\n00:00:01,000 --> 00:00:02,000\nWell...", "pause", "well"),
    ],
)
def test_how_a_text_ends(end, state, final):
    for t in (text(8, "") + end, (text(8, "") + end).replace("\n", "\r\n")):
        assert (tail(t)[0], tail(t)[2]) == (state, final)


def brute(finals, tokens, p=Rules()):
    """Unknown proper prefixes of known tokens, by comparing every pair."""
    counts = Counter(tokens)
    known = {t: n for t, n in counts.items() if n >= p.known}
    out = set()
    for f in finals:
        family = sum(n for t, n in known.items() if t != f and t.startswith(f))
        if family and known.get(f, 0) < max(p.known, p.family * family):
            out.add(f)
    return out


def test_the_trie_against_brute_force(spark):
    rng = random.Random(12)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    tokens = [word(rng.randint(1, 5)) for _ in range(300)] + [word(3) + "x" * k for k in (60, 64, 65, 66, 90, 300)] * 2 + ["y" * 5000] * 2 + ["z"] + ["zebra"] * 9000
    finals = [word(n) for n in (1, 2, 3, 4, 5, 6)] + [tokens[300 + k][: rng.randint(1, 64)] for k in range(6)] + [t[:-1] for t in tokens[300:306]] + tokens[300:306] + ["y" * 64, "y" * 65, "y" * 4999, "y" * 5000, "y" * 5001, "yx", "z", "zeb", "q"]
    pairs = spark.createDataFrame([("", t, 0, 0, 1) for t in tokens], "a string, b string, n long, e long, o long")
    found = _words(spark.createDataFrame([(f,) for f in set(finals)], "final string"), pairs, Rules()).collect()
    assert len(found) == len(set(finals))
    assert {r["final"] for r in found if r["inner"] and not r["known"]} == brute(finals, tokens)


def test_the_trie_alone_finds_cuts_inside_words(spark):
    rng = random.Random(13)
    docs, inside = [], set()
    for i in range(400):
        t = text(rng.randint(8, 16), "")
        if i % 2:
            line = t.rindex("\n") + 1
            ends = [k for k in range(line + 2, len(t) - 2) if t[k - 1].isalpha() and t[k].isalpha() and t[k - 2].isalpha()]
            t = t[: rng.choice(ends)] if ends else t
            inside |= {i} if ends else set()
        docs.append((i, "plain", t))
    found = evidence(spark.createDataFrame(docs, "doc_id long, source string, text string"), "doc_id", "source", "text").filter("trie").collect()
    found = {r["doc_id"] for r in found}
    assert len(found & inside) >= 0.9 * len(inside) and found <= inside


def test_odd_texts():
    assert tail("")[0] == "whole" and tail("\n \n")[0] == "whole"
    tail("x" * 1_000_000), tail("\n" * 100_000 + "a"), tail("-->"), tail("no cues at all")


@pytest.fixture(scope="module")
def corpus():
    docs, cut = [], set()
    for i in range(300):
        t, source = text(RNG.randint(6, 14)), "plain" if i % 3 else None
        docs.append([i, source, t])
    for i in range(300, 400):  # a source with a field of 500 characters
        t = text(12)[:500]
        docs.append([i, "field", t])
        last = t[t.rindex("-->") :] if "-->" in t else ""
        if not t.rstrip().endswith((".", "?", "!")) or "\n" not in last:
            cut.add(i)
    for i, ending in ((10, "\n\n9\n00:00:40,000 --> 00:00:41,000\nThe End\n"), (11, "\n\n9\n00:00:40,000 --> 00:00:41,000\nThe End\n"), (12, "\n\n9\n00:00:40,000 --> 00:00:41,000\nThe End"), (13, "\n\n9\n00:00:40,000 --> 00:00:41,000\nThe End\n")):
        docs[i][2] = docs[i][2].rstrip("\n") + ending
    docs[20][2] = docs[20][2].rstrip("\n") + "\n\n9\n00:00:40,000 --> 00:00:41,000\nShe borrowed the blan"
    docs[21][2] = docs[21][2].rstrip("\n") + "\n\n9\n00:00:40,000 --> 00:00:41,000\nShe borrowed the"
    cut |= {20, 21}
    caps = [x.rstrip(".?!").upper() for x in SENTENCES]
    docs[30][2] = text(9, "\n", caps + caps[:2])
    docs[31][2] = text(9, "", caps + ["WHERE IS THE CONDUCTOR"])
    docs[32][2] = text(9, "", caps + ["WHERE IS THE CONDUC"])
    cut.add(32)
    docs += [[500, "plain", None], [501, "plain", ""], [502, "plain", "  \n"], [20, "plain", docs[20][2]]]
    return docs, cut


def test_find_truncated(spark, corpus):
    docs, cut = corpus
    df = spark.createDataFrame([tuple(r) for r in docs], "id long, source string, text string").selectExpr("id AS d", "source AS cue", "text AS final", "1 AS verdict").repartition(5)
    verdicts = find_truncated(df, "d", "cue", "final")
    rows = verdicts.collect()
    assert len(rows) == len(docs)
    assert {r["doc_id"] for r in rows if r["cut"]} == cut
    shares = {r["source"]: r for r in share_by_source(verdicts).collect()}
    assert set(shares) == {"plain", "field", None} and shares["field"]["documents"] == 100
    assert shares["field"]["by_length"] > 0.8 * shares["field"]["cut"] and shares["plain"]["by_length"] == 0
    assert find_truncated(df.limit(0), "d", "cue", "final", Rules()).count() == 0


def test_words_of_captions_without_punctuation_are_known(spark):
    docs = [[i, "plain", text(8)] for i in range(40)]
    captions = ["THE ZEPPELINS ARE COMING", "NEVER TRUST A HARLEQUIN AGAIN", "A GREAT ZEPPELINS PARADE"] * 4
    docs += [[100 + i, "caps", text(12, "\n", captions)] for i in range(5)]
    docs += [[110, "caps", text(9, "", captions + ["WE SAW THE ZEPPEL"])], [111, "caps", text(9, "", captions + ["WE SAW A HARLEQUIN"])]]
    docs += [[120 + i, "short", "blan again"] for i in range(2)]  # under three tokens
    docs += [[130, "plain", text(8, "", captions + ["WE SAW THE BLAN"])], [131, "plain", text(8, "", captions + ["WE SAW THE BLANK"])]]
    df = spark.createDataFrame([tuple(r) for r in docs], "doc_id long, source string, text string")
    assert {r["doc_id"] for r in find_truncated(df, "doc_id", "source", "text").collect() if r["cut"]} & {110, 111, 130, 131} == {110, 131}
