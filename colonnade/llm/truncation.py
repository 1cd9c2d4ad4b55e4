"""Subtitle texts that were cut off: by a field limit of their source or in mid-transfer.

The vocabulary of the corpus holds every word of every text but the last of each, and the headers of cues (number and time
line, each digit a 0) as tokens of their own; the proper prefixes of known tokens are the nodes of a trie. The final token of
every text that doesn't end with a closed sentence is looked up there. Four kinds of evidence are kept apart:

* trie: the final token is unknown and a proper prefix of known ones, be it a word or a header;
* length: the text lies at a length where texts of its source crowd, and its end is open;
* sentence: the last word (alone and after the word before it) hardly ever ends a sentence, or a cue without closing mark
  stands among punctuated ones and is no known closing title or advert;
* structure: an open tag, bracket or song mark, or a mark that goes on (such as a comma).
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from colonnade.runtime import join_dimension, materialize, small, spread


@dataclass(frozen=True)
class Rules:
    #: a token is known if it occurs so often, and in this part of the occurrences of all tokens that begin with it
    known: int = 2
    family: float = 0.0005
    #: letters up to which prefixes are nodes of their own; longer tokens are compared behind their first so many letters
    head: int = 64
    #: a word or pair ends a sentence if it does so in this part of its occurrences, of which there must be some
    ends: float = 0.02
    pairs: int = 5
    #: different texts, and part of all texts, that end in the same unpunctuated cue and a line end after it make a closing title
    closing: int = 3
    closing_part: float = 1e-5
    #: times that an advert must be seen as a cue within texts
    adverts: int = 2
    #: first words of a line of credits; such a line is an advert if it has ``by`` in it. Empty: only addresses make adverts
    credits: str = r"synced|subtitles?|encoded|ripped|captions?|captioned|translat\w+|corrected|timed"
    #: a text without sentence ends in this part of its words is one of captions without punctuation
    unpunctuated: float = 0.02
    #: the last cues of a text are captions without punctuation below this
    spoken: float = 0.05
    #: texts within ``near`` of their source's greatest length are at its limit if they are at least ``crowd``, and that many times as dense as those below
    near: int = 20
    crowd: int = 4
    dense: float = 4.0


_TIME = re.compile(r"(?:^|\n)(?:[ \t]*\d+[ \t]*\n)?[^\n]*-->[^\n]*(?=\n|$)")
#: a time line or its beginning
_PART = re.compile(r"\d[\d:.,]*(?:\s*-{0,2}>?\s*[\d:.,]*)?")
_TAG = re.compile(r"</?[a-zA-Z0-9]{1,2}>")
_ADDRESS = re.compile(r"[A-Za-z0-9_-]\.[a-z]{2,}")
_FRAMED = re.compile(r"^\s*-=")
#: a mark inside a word is a lost letter
_SENTENCE = re.compile(r"[.!?…](?=[\s\"'”’»<—]|$)")
_CLOSERS = "\"'”’»“"
_ENDS = ".!?"
_OPEN = set(",;:-–+=&|/<([{¿¡$@_\\")
_BREAKS = bytes.maketrans(b"\"#$%&()*+,/:;<=>@[\\]^_`{|}~\t\r\n!?", b" " * 30 + b"..")
_APART = [(c.encode(), b" ") for c in "♪«»“”„—–"] + [("…".encode(), b".")]
_DIGITS = str.maketrans("123456789", "000000000")
#: how a text ends: blank or closed (nothing to ask), else what its open end is
STATES = ("whole", "header", "broken", "pause", "advert", "title", "words")
_SCHEMA = T.StructType(
    [
        T.StructField("state", T.StringType()),
        T.StructField("before", T.StringType()),
        T.StructField("final", T.StringType()),
        T.StructField("cue", T.StringType()),
        T.StructField("closed", T.BooleanType()),
        T.StructField("chars", T.IntegerType()),
        T.StructField("bytes", T.IntegerType()),
    ]
)


#: a letter lost in recoding, and one decoded into a letter and a mark
_LOST = re.compile(rb"(?<=[a-z\x80-\xff])\?(?=[a-z\x80-\xff])")
_RECODED = re.compile("ã(?:“|”|„|–|—)(?=[a-z])".encode())


def _split(text: str) -> list[bytes]:
    """Words in lower case, sentence ends as words of their own."""
    b = text.lower().encode("utf-8", "replace")
    if not b.isascii():
        b = _RECODED.sub(b"\xef\xbf\xbd", b)
        for mark, by in _APART:
            b = b.replace(mark, by)
    return _LOST.sub(b"\xef\xbf\xbd", b).translate(_BREAKS).replace(b".", b" . ").split()


def _plain(text: str) -> str:
    return text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text


def _credit(words: str) -> re.Pattern:
    return re.compile(rf"(?i)^\W*(?:{words})\b.*\bby\b") if words else re.compile(r"(?!)")


def _advert(line: str, p: Rules) -> bool:
    return bool(_ADDRESS.search(line) or _FRAMED.search(line) or _credit(p.credits).search(line))


def header(number: bool, time: str) -> str:
    """The token of a cue's header: # for the number, the time line with each digit a 0, and a mark for the words that follow."""
    return ("#\n" if number else "") + time.strip().translate(_DIGITS)


def _open_header(body: str) -> str | None:
    """The token of the header within which a text ends, or None if it ends elsewhere."""
    lines = body.rsplit("\n", 2)
    line, above = lines[-1].strip(), lines[-2].strip() if len(lines) > 1 else ""
    shut = line.removesuffix("…").rstrip(".") or line
    if shut.isdecimal() and "-->" not in above:
        return "#"
    if "-->" in line or ("-->" not in above and _PART.fullmatch(shut)):
        return header(above.isdecimal(), shut)
    return None


def tail(text: str, p: Rules = Rules()) -> tuple[str, str, str, str, bool]:
    """(state, word before, last token, last cue, line end behind) of a text's end.

    States: whole (blank or closed), header (within the number or time line of a cue, or behind it without words), broken
    (open markup, or a mark that goes on), pause (an ellipsis), advert, title (an unpunctuated cue among punctuated ones),
    words (captions without punctuation).
    """
    t = _plain(text)
    closed = t.endswith("\n")
    body = t.rstrip()
    if not body:
        return "whole", "", "", "", closed
    if (token := _open_header(body)) is not None:
        return "header", "", token, "", closed
    at = [m for m in _TIME.finditer(body)]
    cue = body[at[-1].end() :].strip() if at else body
    bare = _TAG.sub("", cue).strip()
    flat = " ".join(bare.split())
    spoken = [w.decode("utf-8", "replace") for w in _split(bare) if w != b"."]
    if len(spoken) < 2 and at:
        earlier = _split(_TAG.sub("", body[at[-2].end() : at[-1].start()] if len(at) > 1 else ""))
        spoken = [w.decode("utf-8", "replace") for w in earlier[-1:] if w != b"."] + spoken
    final, before = spoken[-1] if spoken else "", spoken[-2] if len(spoken) > 1 else ""
    end = before, final, flat, closed
    last = bare[bare.rfind("\n") + 1 :].strip()
    if last.endswith("=-"):
        return "whole", *end
    opened = len(re.findall(r"<[il1]>", cue)) - cue.count("</i>")
    if opened > 0 or re.search(r"<[^>]*$", cue) or last.count("[") > last.count("]") or last.count("(") > last.count(")"):
        return "broken", *end
    if (last.startswith("♪") and not (last.endswith("♪") and len(last) > 2)) or last.startswith("-="):
        return "broken", *end
    if _advert(last, p):
        return "advert", *end
    shut = last.rstrip(_CLOSERS)
    if not shut or shut[-1] in _OPEN:
        return "broken", *end
    if shut.endswith(("...", "…")):
        return "pause", *end
    # a recoded note or ellipsis closes too
    if shut[-1] in _ENDS or shut[-1] in "ªº¦" or not (shut[-1].isalnum() or shut[-1] in "'’"):
        return "whole", *end
    lately = _TAG.sub("", _TIME.sub("\n", body[at[-6].start() if len(at) > 5 else 0 : at[-1].start()] if at else ""))
    lately = "\n".join(x for x in lately.split("\n") if not (_advert(x, p) or x.strip()[:1] in "[(*♪-="))
    ends, said = len(_SENTENCE.findall(lately)), len(lately.split())
    return ("words" if said and ends < p.spoken * said else "title"), *end


def count_words(texts: list[str | None], p: Rules = Rules()) -> tuple[Counter, Counter, Counter, Counter]:
    """Pairs of words, pairs that end a sentence, adverts as whole cues, and tokens that stand in no pair, over all of the texts but their last tokens.

    Captions without punctuation and texts under three words tell nothing of sentence ends: their words stand in no pair.
    """
    adverts: Counter = Counter()
    others: Counter = Counter()
    every: list[bytes] = []
    credit = _credit(p.credits)
    for text in texts:
        if not text:
            continue
        plain = _plain(text)
        cues, heads, begin = [], [], 0
        for m in _TIME.finditer(plain):
            cues.append(plain[begin : m.start()])
            heads.append(m.group())
            begin = m.end()
        cues.append(plain[begin:])
        if heads and not cues[-1].strip():
            heads.pop()  # the text ends with it
        for h in heads:
            lines = h.strip("\n").rsplit("\n", 1)
            others[header(len(lines) > 1, lines[-1]).encode("utf-8", "replace") + b"\n."] += 1
        t = "\n".join(cues[:-1])
        if _ADDRESS.search(t) or " by " in t:
            for c in cues[:-1]:
                if _ADDRESS.search(c) or (" by " in c and credit.search(c.strip())):
                    adverts[" ".join(_TAG.sub("", c).split())] += 1
        t = f"{t}\n{cues[-1]}"
        w = _split(_TAG.sub("", t) if "<" in t else t)
        while w and w[-1] == b".":
            w.pop()
        if len(w) >= 3 and w.count(b".") >= p.unpunctuated * len(w):
            w[-1] = b""  # the last word is left out, and parts one text from the next
            every += w
            others[w[0]] += 1  # no word before it
        else:
            others.update(w[:-1])
    del others[b"."], others[b""]
    pairs = Counter(zip(every, every[1:]))
    stops = [i for i, x in enumerate(every) if x == b"." and i > 1]
    ends = Counter([(every[i - 2], every[i - 1]) for i in stops])
    return pairs, ends, adverts, others


def _tails(p: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string()] * 4 + [pa.bool_(), pa.int32(), pa.int32()]
        for b in batches:
            rows = [(*tail(t, p), len(t), len(t.encode("utf-8", "replace"))) if t and t.strip() else ("whole", "", "", "", False, 0, 0) for t in b.column(3).to_pylist()]
            made = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), *made], names=["doc_id", "source", "print", *_SCHEMA.names])

    return run


def _counts(p: Rules):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pairs: Counter, ends: Counter, adverts: Counter, others: Counter) -> pa.RecordBatch:
            for x in [x for x in pairs if not x[0] or not x[1] or x[1] == b"."]:
                del pairs[x]
            a = [x[0].decode("utf-8", "replace") for x in pairs] + [""] * (len(others) + len(adverts))
            b = [x[1].decode("utf-8", "replace") for x in pairs] + [x.decode("utf-8", "replace") for x in others] + list(adverts)
            n = [*pairs.values(), *[0] * len(others), *adverts.values()]
            e = [ends.get(x, 0) for x in pairs] + [0] * (len(others) + len(adverts))
            seen = [*pairs.values(), *others.values(), *adverts.values()]
            advert = [False] * (len(pairs) + len(others)) + [True] * len(adverts)
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), *[pa.array(x, pa.int64()) for x in (n, e, seen)], pa.array(advert, pa.bool_())], names=["a", "b", "n", "e", "o", "advert"])

        total = (Counter(), Counter(), Counter(), Counter())
        for b in batches:
            for at in range(0, b.num_rows, 500):
                for whole, part in zip(total, count_words(b.column(0).slice(at, 500).to_pylist(), p)):
                    whole.update(part)
                if len(total[0]) + len(total[3]) > 300_000:  # held counts stay small, whatever the partition
                    yield out(*total)
                    total = (Counter(), Counter(), Counter(), Counter())
        yield out(*total)

    return run


def evidence(documents: DataFrame, doc_id: str, source: str, text: str, p: Rules = Rules()) -> DataFrame:
    """Every document with the evidence of a cut: (doc_id, source, trie, length, sentence, structure), each a boolean.

    Null, empty and blank texts are whole. Documents that repeat count each, and a null source is a source of its own. An
    empty table gives no rows. Token counts cover every text, ratios of sentence ends those with punctuation; they are combined before they are shuffled.
    """
    slim = spread(documents.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{source}`").alias("source"), F.xxhash64(F.col(f"`{text}`")).alias("print"), F.col(f"`{text}`").alias("text")))
    fields = [T.StructField("doc_id", documents.schema[doc_id].dataType), T.StructField("source", documents.schema[source].dataType), T.StructField("print", T.LongType()), *_SCHEMA.fields]
    tails = materialize(slim.mapInArrow(_tails(p), T.StructType(fields)), "tails")
    counted = spread(documents.select(text)).mapInArrow(_counts(p), "a string, b string, n long, e long, o long, advert boolean")
    counts = materialize(counted.groupBy("a", "b", "advert").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("o").alias("o")), "pairs")

    # what the open ends ask of the corpus: one row for each distinct last token, pair and cue
    open_ = tails.filter("state <> 'whole'")
    pairs = counts.filter(~F.col("advert"))
    words = materialize(_words(open_.select("final").filter("final <> ''").distinct(), pairs, p), "words")
    asked_pairs = open_.select(F.col("before").alias("a"), F.col("final").alias("b")).distinct()
    two = asked_pairs.join(pairs.filter("n > 0").select("a", "b", F.col("n").alias("pn"), F.col("e").alias("pe")), ["a", "b"], "inner").withColumnRenamed("a", "before").withColumnRenamed("b", "final")
    cues = materialize(_complete(tails, open_, counts, p), "cues")

    out = open_
    for dimension, on in ((words, ["final"]), (materialize(two, "two"), ["before", "final"]), (cues, ["cue"]), (_limits(tails, p), ["key"])):
        out = join_dimension(out.withColumn("key", _key()) if on == ["key"] else out, dimension, on, "left")
    no = lambda c: F.coalesce(c if isinstance(c, Column) else F.col(c), F.lit(False))
    state, closed = F.col("state"), F.col("closed")
    complete = F.when(state == "advert", no("seen") | closed).otherwise(no("title"))
    fragment = ~no("known") & no("inner") & ~complete
    at_limit = no((no("by_chars") & (F.col("chars") > F.col("max_chars") - p.near)) | (no("by_bytes") & (F.col("bytes") > F.col("max_bytes") - p.near)))
    pair_ends = F.when(F.col("pn") >= p.pairs, F.col("pe") >= p.ends * F.col("pn")).otherwise(F.coalesce(F.col("we") >= p.ends * F.col("wn"), F.lit(True)))
    # behind a line end only words that plainly never end a sentence tell
    never = F.coalesce((F.col("pn") >= p.pairs) & (F.col("pe") == 0) & (F.col("we") < p.ends * F.col("wn")), F.lit(False))
    unended = F.when(state.isin("advert", "title"), ~complete).when((state == "words") & ~complete, F.when(closed, never).otherwise(~pair_ends))
    told = out.select("doc_id", "source", fragment.alias("trie"), (at_limit & ~complete).alias("length"), no(unended).alias("sentence"), (state == "broken").alias("structure"))
    false = F.lit(False)
    return told.unionByName(tails.filter("state = 'whole'").select("doc_id", "source", *[false.alias(c) for c in EVIDENCE]))


def _words(finals: DataFrame, pairs: DataFrame, p: Rules) -> DataFrame:
    """Of each asked token: wn and we (occurrences among punctuated words, and at sentence ends), known, and inner: it is a node of the trie.

    Nodes are the proper prefixes, up to ``head`` letters, of all known tokens; only those that are asked for are shuffled
    on. Longer asked tokens are held against the known ones that begin with the same ``head`` letters.
    """
    vocabulary = pairs.groupBy("b").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), F.sum("o").alias("o")).filter(F.col("o") >= p.known)
    vocabulary = materialize(vocabulary, "vocabulary")
    longer = vocabulary.filter(F.length("b") > 1).select("b", "o")
    nodes = longer.select("o", F.explode(F.expr(f"transform(sequence(1, least(length(b) - 1, {p.head})), k -> substring(b, 1, k))")).alias("final"))
    asked = F.broadcast(finals) if small(finals) else finals
    family = nodes.join(asked, "final", "left_semi").groupBy("final").agg(F.sum("o").alias("family"))
    beyond = finals.filter(F.length("final") > p.head).withColumn("start", F.substring("final", 1, p.head))
    rest = longer.filter(F.length("b") > p.head + 1).withColumn("start", F.substring("b", 1, p.head))
    far = beyond.join(rest, (beyond["start"] == rest["start"]) & (F.length("b") > F.length("final")) & F.col("b").startswith(F.col("final")), "left_semi").select("final", F.lit(1).cast("long").alias("family"))
    found = finals.join(vocabulary.withColumnRenamed("b", "final"), "final", "left").join(family.unionByName(far), "final", "left")
    known = F.col("o").isNotNull() & (F.col("o") >= F.lit(p.family) * F.coalesce("family", F.lit(0)))
    return found.select("final", *[F.when(F.col("n") >= p.known, F.col(c)).alias(f"w{c}") for c in ("n", "e")], known.alias("known"), F.col("family").isNotNull().alias("inner"))


def _complete(tails: DataFrame, open_: DataFrame, counts: DataFrame, p: Rules) -> DataFrame:
    """Last cues that are complete without a closing mark: (cue, seen, title). Copies of a text count once."""
    texts = tails.count()
    least = max(p.closing, p.closing_part * texts)
    titles = open_.filter("state in ('title', 'words') and closed").groupBy("cue", "print").agg(F.lit(1).alias("one")).groupBy("cue").agg(F.count("*").alias("c")).filter(F.col("c") >= F.lit(least))
    adverts = counts.filter("advert").filter(F.col("n") >= p.adverts).select(F.col("b").alias("cue"))
    seen = adverts.join(open_.filter("state = 'advert'").select("cue").distinct(), "cue", "left_semi")
    both = seen.withColumns({"s": F.lit(True), "t": F.lit(False)}).unionByName(titles.select("cue", F.lit(False).alias("s"), F.lit(True).alias("t")))
    return both.groupBy("cue").agg(F.max("s").alias("seen"), F.max("t").alias("title"))


EVIDENCE = ("trie", "length", "sentence", "structure")


def cut_by(of: tuple[str, ...] = EVIDENCE) -> Column:
    """Whether any of these kinds of evidence says that a text was cut."""
    return reduce(Column.__or__, [F.col(c) for c in of])


def find_truncated(documents: DataFrame, doc_id: str, source: str, text: str, p: Rules = Rules()) -> DataFrame:
    """Every document with its verdict, (doc_id, source, cut), and the evidence that it rests on; see ``evidence``."""
    return evidence(documents, doc_id, source, text, p).withColumn("cut", cut_by())


def _key() -> Column:
    """The source as a join key that null sources have too."""
    return F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))


def _limits(tails: DataFrame, p: Rules) -> DataFrame:
    """Per source its greatest length in characters and bytes, and whether texts crowd there."""
    sized = tails.select(_key().alias("key"), "chars", "bytes")
    top = materialize(sized.groupBy("key").agg(F.max("chars").alias("max_chars"), F.max("bytes").alias("max_bytes")), "longest")
    both = join_dimension(sized, top, ["key"], "inner")
    counted = []
    for kind in ("chars", "bytes"):
        top_, here = F.col(f"max_{kind}"), F.col(kind)
        counted.append(F.count_if(here > top_ - p.near).alias(f"at_{kind}"))
        counted.append(F.count_if((here <= top_ - p.near) & (here > top_ - 11 * p.near)).alias(f"below_{kind}"))
    seen = both.groupBy("key").agg(F.first("max_chars").alias("max_chars"), F.first("max_bytes").alias("max_bytes"), *counted)
    crowd = lambda k: (F.col(f"at_{k}") >= p.crowd) & (F.col(f"at_{k}") >= p.dense * F.col(f"below_{k}") / 10)
    return materialize(seen.select("key", "max_chars", "max_bytes", crowd("chars").alias("by_chars"), crowd("bytes").alias("by_bytes")), "limits")


def share_by_source(verdicts: DataFrame) -> DataFrame:
    """Per source the documents, those cut off, their share, and how many each kind of evidence shows, alone or with others."""
    each = [F.count_if(c).alias(f"by_{c}") for c in EVIDENCE]
    return verdicts.groupBy("source").agg(F.count("*").alias("documents"), F.count_if("cut").alias("cut"), F.avg(F.col("cut").cast("double")).alias("share"), *each)
