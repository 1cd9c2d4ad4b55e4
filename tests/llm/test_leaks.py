import random

import numpy as np
import pytest

from colonnade.llm.leaks import Items, Pair, Run, Tiling, _one_run, find_leaks, words

RNG = random.Random(3)
NOUNS = "lantern harbour kettle mirror saddle orchard violin whistle parcel blanket ladder furnace tunnel basket candle".split()
VERBS = "mended carried weighed painted borrowed counted guarded buried dropped polished wrapped stole".split()
PLACES = "Velmora Ostrey Thornby Pinlock Dunmere Eskaville".split()


def sentence():
    pick = RNG.choice
    return f"{pick(PLACES)} {pick(VERBS)} the {pick(NOUNS)}, then {pick(['seven', 'twenty', 'forty'])} {pick(NOUNS)}s {pick(VERBS)} a silver {pick(NOUNS)} near {pick(PLACES)}."


ITEMS = [(i, " ".join(sentence() for _ in range(3))) for i in range(20)]
FILLER = ["Come here.", "Are you sure?", "Thank you.", "Hold on, Oswin.", "We leave before dawn."]


def cues(lines, separator=",", end="\n"):
    return "\n".join(f"{k}\n00:00:{k % 60:02d}{separator}000 --> 00:00:{k % 60:02d}{separator}900\n{x}\n" for k, x in enumerate(lines, 1)).replace("\n", end)


def wrapped(text, n=5):
    w = text.split()
    return [" ".join(w[i : i + n]) for i in range(0, len(w), n)]


def leaked(text, items=ITEMS):
    index = Items(items, Tiling())
    return {index.ids[i] for _, i, n in index.leaks([text]) if n >= 12}


def part(item, a, n):
    return " ".join(ITEMS[item][1].split()[a : a + n])


def test_a_passage_of_twelve_words_and_one_of_eleven():
    assert leaked(cues([*FILLER, *wrapped(part(3, 5, 12)), *FILLER])) == {3}
    assert leaked(cues([*FILLER, *wrapped(part(3, 5, 11)), *FILLER])) == set()


@pytest.mark.parametrize(
    "damage",
    [
        lambda ls: cues(ls, end="\r\n"),
        lambda ls: cues([x.upper() for x in ls], "."),
        lambda ls: cues([f"<i>{x}</i>" for x in ls]),
        lambda ls: cues([x.replace("l", "1").replace("o", "0").replace("m", "rn") for x in ls]),
        lambda ls: cues([x.replace("e", "c").replace("t", "f").replace("h", "li") for x in ls]),
        lambda ls: cues([y for x in ls for y in (x, "[door creaks]", "Best deals on kettles! www.lines.example")]),
        lambda ls: cues([y for x in ls for y in (x, "Become a member of lines.test\nto remove all ads")]),
        lambda ls: cues([f"JUNIA: {x}" for x in ls]),
        lambda ls: cues([f"{a}\n{b}" for a, b in zip(ls, ls[1:])]),  # rolling captions repeat a line
        lambda ls: cues([x.replace(",", "").replace(".", "") for x in ls]),
        lambda ls: cues([f"{x[:-2]}-\n{x[-2:]}" if x[-3:].isalpha() else x for x in ls]),
    ],
)
def test_damage_between_and_inside_words(damage):
    assert leaked(damage([*FILLER, *wrapped(part(7, 2, 20)), *FILLER])) == {7}


def test_rewording_and_reordering():
    w = ITEMS[4][1].split()
    w[::5] = ["something"] * len(w[::5])
    assert leaked(cues(wrapped(" ".join(w)))) == set()
    # sentences in another order: each stretch counts for itself
    other = part(5, 14, 14) + " Thank you. " + part(5, 0, 14)
    assert leaked(cues(wrapped(other))) == {5}


def test_accents_however_they_were_decoded():
    item = [(0, "Après que Célia eut compté la théière trente fois, la couturière quitta Sainte-Ombre, tordu et très énervé.")]
    text = item[0][1]
    forms = [text, text.encode().decode("cp1252", "replace"), text.encode("cp1252").decode("cp437"), text.encode("cp1252").decode("ascii", "replace"), "".join(c if c.isascii() else "?" for c in text)]
    for form in forms:
        assert leaked(cues(wrapped(form, 6)), item) == {0}, form


def test_words_of_odd_texts():
    assert words("") == [] and words("\n\n") == [] and words("1\n00:00:01,000 --> 00:00:02,000\n") == []
    assert len(words("a" * 1_000_000)) == 1 and len(words("word " * 200_000 + "\n" * 1000)) == 200_000


def test_find_leaks(spark):
    docs = [(1, cues(wrapped(ITEMS[0][1])), 9), (1, cues(wrapped(ITEMS[0][1])), 9), (2, None, 9), (3, "", 9), (None, cues(wrapped(part(6, 0, 15))), 9), (5, cues(FILLER), 9)]
    d = spark.createDataFrame(docs, "id long, text string, words int").repartition(3)
    i = spark.createDataFrame([*ITEMS, (99, None), (98, ""), (97, "too short"), (None, ITEMS[0][1])], "id int, text string")
    rows = sorted((str(r["doc_id"]), str(r["item_id"])) for r in find_leaks(d, i, "id", "text", "id", "text").collect())
    assert rows == sorted([("1", "0"), ("1", "None")] * 2 + [("None", "6")])
    full = sorted((str(r["doc_id"]), str(r["item_id"])) for r in find_leaks(d, i, "id", "text", "id", "text", Tiling(most_bits=64)).collect())
    assert full == rows  # filters that let nearly everything through
    assert find_leaks(d.limit(0), i, "id", "text", "id", "text").count() == find_leaks(d, i.limit(0), "id", "text", "id", "text").count() == 0


def test_one_seed_is_enough():
    item = [(0, "Velmora carried the lantern towards seven kettles near violins beside the orchard")]
    w = item[0][1].split()
    assert len(w) == 12
    w[4], w[8] = "towxrds", "vixlins"  # clean runs of 4, 3 and 3 words
    assert leaked(cues([*FILLER, *wrapped(" ".join(w)), *FILLER]), item) == {0}
    w[4] = "underneath"
    assert leaked(cues([*FILLER, *wrapped(" ".join(w)), *FILLER]), item) == set()


def test_reordered_passages_by_coverage(spark):
    w = "Velmora carried seven lanterns across the frozen harbour while Ostrey guarded twenty painted kettles and Thornby buried a silver violin beneath the orchard near Pinlock before dawn came slowly".split()[:30]
    three = [w[20:30], w[10:20], w[:10]]
    docs = [(1, cues([x for part in three for x in [*wrapped(" ".join(part)), "Thank you."]])), (2, cues([*wrapped(" ".join(three[0])), "Thank you.", *wrapped(" ".join(three[1]))]))]
    d = spark.createDataFrame(docs, "id long, text string")
    i = spark.createDataFrame([(7, " ".join(w))], "id int, text string")
    rows = find_leaks(d, i, "id", "text", "id", "text").collect()
    assert [(r["doc_id"], r["item_id"], r["words"], r["covered"]) for r in rows] == [(1, 7, 10, len(w))]
    assert find_leaks(d, i, "id", "text", "id", "text", Tiling(coverage=1.1)).count() == 0 and find_leaks(d, i, "id", "text", "id", "text", Tiling(coverage=0.6)).count() == 2


OTHERS = [
    "старый фонарщик принёс серебряный чайник из тихой гавани и спрятал его под скрипкой возле сада на рассвете",
    "ο παλιός φαροφύλακας έφερε τον ασημένιο βραστήρα από το ήσυχο λιμάνι και τον έκρυψε κάτω από το βιολί",
    "حمل الحارس القديم الفانوس الفضي من الميناء الهادئ ثم أخفاه تحت الكمان قرب البستان قبل الفجر بقليل",
    "पुराने पहरेदार ने चाँदी की केतली शांत बंदरगाह से लाकर बगीचे के पास वायलिन के नीचे छिपा दी थी",
    "古い灯台守は静かな港から銀のやかんを運んで果樹園のそばに隠した",
]


@pytest.mark.parametrize("text", OTHERS)
def test_other_scripts(text):
    lines = [text[k : k + 9] for k in range(0, len(text), 9)] if " " not in text else wrapped(text)
    other = "москва" if text != OTHERS[0] else "paris"
    assert leaked(cues([*FILLER, *lines, *FILLER]), [(1, text), (2, f"{other} " * 15)]) == {1}
    assert leaked(cues([*FILLER, *lines[: len(lines) // 3], *FILLER]), [(1, text)]) == set()


def test_a_full_stop_without_a_space_is_no_address():
    assert words("1\n00:00:01,000 --> 00:00:02,000\ncome home.then we left\n") == words("1\n00:00:01,000 --> 00:00:02,000\ncome home. then we left\n") != []
    assert words("1\n00:00:01,000 --> 00:00:02,000\nBest deals on kettles! www.lines.example\n") == []


def test_a_single_run_measures_as_the_tiling_does():
    rng = random.Random(21)
    names = [f"w{k}x".encode() for k in range(20)]
    at, p = list(range(20)), Tiling()
    for _ in range(300):
        q, n = rng.randrange(0, 12), rng.randint(4, 8)
        raw = [rng.choice([b"other", b"things", names[rng.randrange(20)]]) for _ in range(30)]
        d = rng.randrange(12)
        for j in range(-3, n + 3):
            if 0 <= q + j < 20 and 0 <= d + j < 30:
                raw[d + j] = names[q + j] if 0 <= j < n else rng.choice([names[q + j], names[q + j] + b"z", b"else"])
        known = np.array([w == b"things" for w in raw])
        seeds = [(x, y) for x in range(len(raw) - 3) for y in range(17) if raw[x : x + 4] == names[y : y + 4]]
        pos, places = [x for x, _ in seeds], [y for _, y in seeds]
        if _one_run(pos, places):
            flags = (known | np.array([w in names for w in raw])).astype(np.uint8).tobytes()
            assert Run(raw, flags, names, at, p).measure(min(pos), min(places), len(pos) + 3) == Pair.of(raw, known, names, at, p).measure(pos, places)
