"""Secret scans by zstandard novelty.

A candidate is an unbroken string in a sensitive context: 12 characters after a word such
as token, password or api key, 8 with letters and digits where a separator stands between
(also on the next line, and after names that end in key or pass), whatever is printable
between quotes if it has a digit, the password in a URL, a PEM private key over all its
lines, or what has the prefix of a known kind of key. Neither values nor the names before them have
a greatest length. What is rejected is searched for names within, whatever its length; of a
rejected quoted value the unbroken string it begins with is a candidate as well.

It is measured by its marginal compressed bytes: the text around it is compressed with and
without it, primed with a dictionary (:func:`dictionary`): common code, and the identifiers that
surround candidates in the corpus, by the number of documents over all of it that have them. The
dictionary has room for the most frequent; the others are looked up (:class:`Dictionary`), and those
that a value has are put before its surroundings. Candidates
themselves aren't counted, so no copies of a secret make it known. What the surroundings
or the dictionary explain (names, placeholders) adds few bytes; a candidate of at least
``novelty`` bytes a character (``letters`` if it is letters only or has spaces) and ``least_bytes``
is reported. Other copies of the value don't count as surroundings. A value longer than BLOCK is
measured in blocks from its end on, so that all names within one long run take linear time.

Only texts that an RE2 scan finds to hold a candidate are looked at further; what shuffles are
identifiers and their counts.

Defined cases: null and empty texts have no secrets; every occurrence is reported, also
of equal values; repeated rows are scanned each for itself; an empty table gives an
empty result; extra columns don't matter. Long texts are scanned whole; the
surroundings measured are WINDOW characters to either side.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import anonymous, pick, place, stash

NOVELTY = 0.45
#: Letters alone are words more often than secrets and must be newer.
NOVELTY_LETTERS = 0.85
LEAST_BYTES = 9
WINDOW = 400
LEVEL = 6
MASK = "<SECRET>"

_WORDS = "passwords?|passwd|passphrase|pwd|secrets?|tokens?|api[_ -]?keys?|access[_ -]?keys?|private[_ -]?keys?|signing[_ -]?keys?|encryption[_ -]?keys?|credentials?|bearer|authorization|auth"
_PART = "[A-Za-z0-9_-]"
#: A match reads so much of a run; ``_span`` has its end, as each name within would read all the rest again.
REACH = 250
_PREFIXED = f"(?:AKIA|ASIA)[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{30,{REACH}}}|xox[abprs]-[A-Za-z0-9-]{{10,{REACH}}}|AIza{_PART}{{30,{REACH}}}|sk[-_]{_PART}{{20,{REACH}}}|" + "eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}(?:[.][A-Za-z0-9_-]+)?"
#: A name that goes on for longer is read once, from its start, wherever the word stands in it.
_NAME = f"(?:(?i:{_WORDS}){_PART}{{0,24}}|(?<!{_PART})(?={_PART}{{25}})(?={_PART}*?(?i:{_WORDS})){_PART}+)"
#: Names that end in key or pass (account_key, DB_PASS) only count before a separator.
_BARE = "(?:\\b|_)(?i:key|pass)"
_CLOSE = "[\"'\\])]*"
_SCHEME = "(?i:bearer[ \\t]+|basic[ \\t]+)?"
#: The value may stand on the next line.
_STRONG = f"(?:{_NAME}|{_BARE}){_CLOSE}[ \\t]*(?:=>|:=|=|:)\\s*"
_WEAK = f"{_NAME}{_CLOSE}[ \\t]+(?:(?i:is)[ \\t]+)?"
_QUOTE = "[\"'`]*"
_RUN = "[A-Za-z0-9+/_=.~@!#$%^&*?|-]"
_LONG = "[A-Za-z0-9+/_=.~-]{12}"
#: After a separator, 8 characters are enough if there are letters and digits; runs of REACH or more count whatever they have.
_MIXED = f"(?={_RUN}{{8}})(?={_RUN}{{{REACH}}}|(?={_RUN}*[0-9]){_RUN}*[A-Za-z])"
#: Between quotes all that is printable counts, if there is a digit.
_QUOTED = [(f"{_STRONG}{_SCHEME}{q}(?=[^{q}\\n]*[0-9])", f"[^{q}\\n]{{8,}}", q) for q in "\"'`"]
_PLAIN = f"(?:{_STRONG}{_SCHEME}{_QUOTE}(?:(?={_LONG})|{_MIXED})|{_WEAK}{_SCHEME}{_QUOTE}(?!{_STRONG})(?={_LONG}))({_RUN}{{1,{REACH}}})"
_UNQUOTED = f"(?!{'|'.join(map(''.join, _QUOTED))}){_PLAIN}"
_GAP = "(?:\\s|\\\\[rn])*"
_PEM = f"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----{_GAP}(?:[A-Za-z-]+: [^\\n]*\\s+)*(?:[A-Za-z0-9+/=]{{16,}}{_GAP})+(?:(?:[A-Za-z0-9+/=]{{1,15}}{_GAP})?-----END [A-Z0-9 ]*-----)?"
_URL = "[A-Za-z][A-Za-z0-9+.-]{1,20}://[^\\s:/@\"'<>]*:([^\\s/@\"'<>]{4,})@"
#: Of its groups, one holds the candidate.
PATTERN = "|".join([f"({_PEM}|{_PREFIXED})", _UNQUOTED, *(f"{before}({value}){after}" for before, value, after in _QUOTED), _URL])
_FIND = re.compile(PATTERN)
_WORD = re.compile(f"(?i:{_WORDS}|_?(?:key|pass))")
#: The run that a quoted value begins with; its group is that of unquoted ones.
_BEGIN = re.compile("()" + _PLAIN)
_KEY = re.compile(f"({_PREFIXED})")
#: What goes on beyond REACH, by the first letters of known kinds; other values are read whole.
_TAILS = {kind: re.compile(f"{part}*") for kind, part in {"": _RUN, "gh": "[A-Za-z0-9]", "xo": "[A-Za-z0-9-]", "AI": _PART, "sk": _PART}.items()}
#: For RE2: matches in every text in which PATTERN does.
SCAN = f"-----BEGIN |{_PREFIXED}|{_STRONG}|{_WEAK}{_SCHEME}{_QUOTE}{_LONG}|://[^\\s/]*:[^\\s/]*@".replace(_NAME, f"(?i:{_WORDS}){_PART}*")
#: Longer values are measured in blocks of so many characters.
BLOCK = 1000

#: Identifiers and code that say nothing new where they follow a sensitive word.
DICTIONARY = """
import os sys json re logging requests boto3 hashlib base64 def class self return None True False const let var function await async new null undefined
os.environ["API_KEY"] os.getenv("SECRET_KEY") process.env.ACCESS_TOKEN System.getenv config.get settings.SECRET_KEY getpass.getpass()
api_key apikey api-key access_key access_token refresh_token id_token auth_token session_token csrf_token token_type token_url secret_key client_id client_secret
private_key public_key ssh-rsa ssh-ed25519 password password_hash password_reset passwd username user_name hostname localhost 127.0.0.1 example.com
Authorization: Bearer Basic Content-Type: application/json charset=utf-8 https:// http:// www. .com .org .net
your_api_key_here your-token-here YOUR_SECRET_KEY <your-password> placeholder changeme change_me example sample dummy test testing xxxxxxxxxxxxxxxx ****************
0000000000000000 1111111111111111 1234567890 123456789012345678901234567890 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789abcdef 0123456789ABCDEF deadbeefdeadbeef
the and that with from this which have will would there their about other authentication authorization credentials tokenization tokenizer passwordless
"""

#: An identifier is known from so many documents on; the most frequent prime the compressor up to so many bytes.
LEAST_DOCS = 3
DICTIONARY_BYTES = 32 << 10
_IDENTIFIER = re.compile("(?<![A-Za-z0-9+/=])[A-Za-z_]{3,}(?![A-Za-z0-9+/=])")
_LETTERS = re.compile("[A-Za-z_]{3,}")

FIELDS = ["start", "end", "context", "marginal_bytes", "novelty"]


class Dictionary(str):
    """What primes the compressor; ``rest`` are the known identifiers beyond it that candidates have."""

    rest: frozenset[str] = frozenset()


def _words_in(value: str) -> list[str]:
    """What may be known of a value: its runs of letters and underscores, and their parts."""
    runs = _LETTERS.findall(value)
    return [*runs, *(w for run in runs if "_" in run for w in run.split("_") if len(w) >= 3)]


def _span(text: str, m: re.Match, runs: dict[str, tuple[int, int]]) -> tuple[int, int]:
    """Where the value of a match starts and ends; ``runs`` keeps the last long run of each kind."""
    start, end = m.span(m.lastindex)
    kind = "" if m.lastindex == 2 else text[start : start + 2]
    if m.lastindex > 2 or kind not in _TAILS or end - start < REACH:
        return start, end
    since, stop = runs.get(kind, (0, 0))
    if not since <= start < stop:
        stop = _TAILS[kind].match(text, end).end()
        runs[kind] = start, stop
    return start, stop


class Scanner:
    """Measures candidates; one for each worker, as the primed compressor is costly to make."""

    def __init__(self, dictionary: str = DICTIONARY, novelty: float = NOVELTY, letters: float = NOVELTY_LETTERS, least_bytes: int = LEAST_BYTES):
        primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=LEVEL)
        self._zstd = zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_content_size=False, write_dict_id=False)
        self.novelty, self.letters, self.least = novelty, letters, least_bytes
        self.rest = getattr(dictionary, "rest", Dictionary.rest)

    def marginal(self, before: str, value: str, after: str) -> int:
        """The bytes that ``value`` adds to its compressed surroundings."""
        size = lambda s: len(self._zstd.compress(s.encode("utf-8", "surrogatepass")))
        around = (before + " " + after).replace(value, " ")  # a second copy would explain the first
        if self.rest and (known := [w for w in _words_in(value) if w in self.rest]):
            around = " ".join([*known, around])
        return size(around + value) - size(around)

    def _bytes(self, text: str, start: int, end: int, sums: dict[int, list[int]]) -> int:
        """The marginal bytes of a value; ``sums`` has those of its last blocks, which values of the same end share."""
        at = lambda a, b: self.marginal(text[max(0, a - WINDOW) : a], text[a:b], text[b : b + WINDOW])
        n, last = (end - start - 1) // BLOCK, sums.setdefault(end, [0])
        while len(last) <= n:
            to = end - (len(last) - 1) * BLOCK
            last.append(last[-1] + at(to - BLOCK, to))
        return last[n] + at(start, end - n * BLOCK)

    def find(self, text: str | None) -> list[tuple[int, int, str, int, float]]:
        """Of each secret: where it starts and ends, its context word, marginal bytes, bytes a character."""
        out, at, text, runs, sums = [], 0, text or "", {}, {}
        while m := _FIND.search(text, at):
            word = _sensitive(m)
            at = _within(m, word)  # what is rejected may itself be the name of a value
            for start, end, kind, letters in _values(text, m, word, runs):
                n = self._bytes(text, start, end, sums)
                if n >= self.least and n >= (self.letters if letters else self.novelty) * (end - start):
                    out.append((start, end, kind, n, round(n / (end - start), 4)))
                    at = max(at, end)
                    if start >= m.start(m.lastindex):  # else a key within the name
                        break
        return out


def _sensitive(m: re.Match) -> re.Match | None:
    """The sensitive word of a match, within its text."""
    return _WORD.search(m.group(0)) if 1 < m.lastindex < _FIND.groups else None


def _within(m: re.Match, word: re.Match | None) -> int:
    """Where the search goes on within a rejected match."""
    return m.start() + (word.end() if word and not word.start() else 1)


def _values(text: str, m: re.Match, word: re.Match | None, runs: dict[str, tuple[int, int]]) -> Iterator[tuple[int, int, str, bool]]:
    """(start, end, context, whether it must be as new as letters) of what a match has to measure: a key of a known
    kind within the name, the value, and the run that a quoted value begins with."""
    start, end = _span(text, m, runs)
    if word and (key := _KEY.search(text, m.start(), start)):
        yield *_span(text, key, runs), "known prefix", False
    kind = word.group(0).lower().lstrip("_") if word else "url" if m.lastindex == _FIND.groups else "private key" if text.startswith("-----", start) else "known prefix"
    letters = text[start : min(end, start + BLOCK)].isalpha() and text[start:end].isalpha()
    yield start, end, kind, letters or m.lastindex > 2 and bool(re.search("\\s", text[start:end]))
    if 2 < m.lastindex < _FIND.groups and (run := _BEGIN.match(text, m.start())) and run.span(2) != (start, end):
        start, end = _span(text, run, runs)
        yield start, end, kind, text[start:end].isalpha()


def surroundings(text: str) -> tuple[set[str], set[str]]:
    """The identifiers within WINDOW characters of the candidates of a text, but not within candidates; and
    the identifiers of all that :meth:`Scanner.find` may measure, whatever it rejects."""
    spans, within, at, free, runs, done = [], set(), 0, 0, {}, {}
    while m := _FIND.search(text, at):
        word = _sensitive(m)
        if m.start() >= free:
            spans.append(_span(text, m, runs))
            free = max(spans[-1][1], m.end())
        for start, end, *_ in _values(text, m, word, runs):
            n, before = (end - start - 1) // BLOCK, done.get(end, 0)
            cuts = [(start, end - n * BLOCK), *((end - k * BLOCK, end - (k - 1) * BLOCK) for k in range(before + 1, n + 1))]
            done[end] = max(before, n)
            within.update(w for a, b in cuts for w in _words_in(text[a:b]))
        at = _within(m, word)
    near, at = [], 0
    for i, (start, end) in enumerate(spans):
        near.append(text[max(at, start - WINDOW) : start])
        near.append(text[end : min(end + WINDOW, spans[i + 1][0] if i + 1 < len(spans) else len(text))])
        at = min(end + WINDOW, spans[i + 1][0]) if i + 1 < len(spans) else end
    return {w for part in near for w in _IDENTIFIER.findall(part)}, within


def _hit_texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text) of the texts that may hold a candidate."""
    d = pick(docs, "doc_id", "text")

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.take(pa.array(_hits(b.column("text")), pa.int64()))

    return d.mapInArrow(hits, d.schema)


def _counted(texts: DataFrame) -> Dictionary:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, measured = Counter(), set()
            for i in _hits(b.column("text")):
                near, within = surroundings(b.column("text")[i].as_py())
                found.update(near)
                measured |= within
            words = [*found, *(measured - found.keys())]
            yield pa.RecordBatch.from_pydict({"word": pa.array(words, pa.string()), "n": pa.array([found[w] for w in words], pa.int64()), "measured": pa.array([w in measured for w in words], pa.bool_())})

    n = pick(texts, "text").mapInArrow(count, "word string, n long, measured boolean").groupBy("word").agg(F.sum("n").alias("n"), F.max("measured").alias("measured"))
    n, _ = stash(n.filter(F.col("n") >= LEAST_DOCS), "identifiers")
    words, size = [], 0
    for r in n.orderBy(F.col("n").desc(), "word").limit(DICTIONARY_BYTES // 4).collect():
        size += len(r["word"]) + 1
        if size > DICTIONARY_BYTES:
            break
        words.append(r["word"])
    known = Dictionary(" ".join(reversed(words)) + "\n" + DICTIONARY)  # what is frequent is near
    known.rest = frozenset(r["word"] for r in n.filter("measured").select("word").collect()) - set(words)
    return known


def dictionary(docs: DataFrame) -> Dictionary:
    """What primes the compressor: DICTIONARY and the identifiers around the candidates of all ``docs``."""
    return _counted(docs)


def _hits(texts: pa.Array) -> list[int]:
    found = pc.match_substring_regex(pc.fill_null(texts, ""), SCAN)
    return pc.indices_nonzero(found).to_pylist()


def scan(docs: DataFrame) -> DataFrame:
    """A row for each secret: doc_id, start, end (characters), context, marginal_bytes, novelty."""
    d, _ = stash(_hit_texts(docs), "candidates")
    schema = d.select("doc_id", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("").alias("context"), F.lit(0).alias("marginal_bytes"), F.lit(0.0).alias("novelty")).schema
    known = _counted(d)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(known)
        for b in batches:
            found = [(i, *s) for i, text in enumerate(b.column("text").to_pylist()) for s in scanner.find(text)]
            if found:
                row, *rest = map(list, zip(*found))
                kinds = [pa.int32(), pa.int32(), pa.string(), pa.int32(), pa.float64()]
                yield pa.RecordBatch.from_arrays([b.column("doc_id").take(pa.array(row)), *map(pa.array, rest, kinds)], names=["doc_id", *FIELDS])

    return d.mapInArrow(each, schema)


def _redactor(known: str):
    def redact(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = Scanner(known)
        for texts in parts:
            out = list(texts)
            for i in _hits(pa.array(texts, pa.string(), from_pandas=True)):
                text, at = out[i], 0
                pieces = []
                for start, end, *_ in scanner.find(text):
                    pieces += [text[at:start], MASK]
                    at = end
                out[i] = "".join([*pieces, text[at:]])
            yield pd.Series(out, dtype=object)

    return redact


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with all its rows and columns, each secret in text replaced by MASK; n_chars, if there, follows."""
    text = place(docs, "text")
    clean = F.pandas_udf(_redactor(dictionary(docs)), "string").asNondeterministic()
    d = anonymous(docs).withColumn("_clean", clean(F.col(text)))
    cols = []
    for i, name in enumerate(docs.columns):
        c = F.col("_clean") if f"_in{i}" == text else F.col(f"_in{i}")
        if name == "n_chars":
            c = F.length("_clean").cast(docs.schema[i].dataType)
        cols.append(c.alias(f"_out{i}"))
    return d.select(*cols).toDF(*docs.columns)
