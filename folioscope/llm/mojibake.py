"""Garbled text from wrong character encoding: find it, and restore the original where that can be had.

A chain of wrong decodings turns é into Ã©, √© or Г©. For each text that holds non-ASCII characters every chain is
undone where it can be, and each candidate text is compressed, whole and in its context, with one zstandard dictionary per
language. The candidate of the least description length - compressed bytes plus the cost of the chain - wins; if it isn't
shorter than the text as it stands, the text stays. zstandard counts whole bytes: only where two texts lie less than a byte
apart do the code lengths of their letters decide (the result says which did).

Before they are compressed, texts are written so that no script is dearer than another: a letter that the corpus uses takes
one byte, any other three. A step is undone strictly: a run of characters must read as bytes of the true encoding from end
to end (signs between them may stay), read back to itself, and sound text of other scripts is protected - a word wholly of
another script only becomes known letters or a longer word of one script, and a chain must account for at least half of
the letters of the scripts that it touches. Characters that were lost for good (U+FFFD) mark a text as garbled without
restoring it.

The dictionaries are trained on the words of the whole corpus, counted by language (other scripts are one more) in one
aggregation, of which the ``VOCABULARY`` most frequent of each language reach the driver; words that look garbled don't
count.
"""

from __future__ import annotations

import math
import random
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.common import clean

#: Most words of a language that the dictionaries are trained on; a bound on what reaches the driver.
VOCABULARY = 12_000
DICT_BYTES = 48 * 1024
LEVEL = 3
#: Parts that a language's words are ranked in before the best of each part are ranked together.
PARTS = 16
#: Frequent words by which the language of a text is told.
FUNCTION_WORDS = {
    "en": "the of and to in is that for with on",
    "de": "der die das und ist nicht mit den von zu",
    "fr": "le la les des et est une dans pour que",
    "es": "el los las de y en una que del con",
    "pt": "o os as da do em uma e que com",
}
#: What a text was taken for, what it was, and the cost of the step in bytes.
STEPS = {
    **{f"{w}>utf-8": (w, "utf-8", 1.5 if w in ("gbk", "big5") else 0.5) for w in ("cp1252", "mac_roman", "cp437", "cp850", "cp1250", "cp1251", "gbk", "cp1253", "cp1254", "latin_1", "iso8859_15", "koi8_r", "cp866", "big5")},
    **{f"{w}>cp1252": (w, "cp1252", 0.5) for w in ("mac_roman", "cp437", "cp850", "cp1251", "cp1253", "koi8_r", "cp866")},
}
CHAINS = [*[(s,) for s in STEPS], ("cp1252>utf-8", "cp1252>utf-8"), ("cp1252>utf-8", "cp1252>utf-8", "cp1252>utf-8"), ("mac_roman>utf-8", "cp1252>utf-8"), ("cp1252>utf-8", "mac_roman>utf-8"), ("cp437>utf-8", "cp1252>utf-8"), ("cp1251>utf-8", "cp1252>utf-8"), ("cp1250>utf-8", "cp1252>utf-8")]
_RUN = re.compile(r"[^\x00-\x7f]+")
_WORD = re.compile(r"[^\s,;|\"\[\]{}()/\x1c-\x1f]+".replace(r"\s", r" \t\n\r"))
_MULTI = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|[\xe0-\xef][\x80-\xbf]{2}|[\xf0-\xf4][\x80-\xbf]{3})+")
#: Most non-ASCII characters that count as known (one byte each), and least share of all such characters.
KNOWN, LEAST_KNOWN = 120, 1 / 20_000
#: Letters inside a word that no language here has there: other scripts, box drawing, symbols, lost and control characters.
_ODD = r"[\x{0080}-\x{00A0}\x{0370}-\x{052F}\x{2190}-\x{22FF}\x{2300}-\x{25FF}\x{2E80}-\x{9FFF}\x{F000}-\x{FFFF}\x{00A2}\x{00A5}-\x{00A9}\x{00AC}-\x{00AF}\x{00B2}-\x{00B4}\x{00B6}-\x{00B9}]"
_LATIN = r"[A-Za-z\x{00C0}-\x{024F}]"
_SUSPECT = rf"{_LATIN}{_ODD}|{_ODD}{_LATIN}|[\x{{00C2}}-\x{{00C5}}\x{{00D0}}\x{{00D1}}\x{{00E2}}\x{{0413}}\x{{0102}}\x{{221A}}\x{{251C}}\x{{0152}}][\x{{0080}}-\x{{00BF}}\x{{2000}}-\x{{25FF}}\x{{0139}}-\x{{017E}}\x{{02C6}}-\x{{02DD}}]|[\x{{0420}}\x{{0421}}][\x{{00A0}}-\x{{00BF}}\x{{0402}}-\x{{040F}}\x{{0452}}-\x{{045F}}\x{{2000}}-\x{{21FF}}]|\p{{Ll}}[\x{{00C0}}-\x{{00DE}}]|\x{{FFFD}}"
#: A word of another script.
_OTHER = r"[\x{0370}-\x{1DFF}\x{1F00}-\x{1FFF}\x{2E80}-\x{D7FF}]"


_TABLES: dict[str, dict[str, int]] = {}
_UNDONE: dict[tuple[str, str], str] = {}
_SCRIPTS: dict[str, str] = {}


def script(c: str) -> str:
    """L Latin, G Greek, C Cyrillic, H Chinese and Japanese, K Korean, else the block of a letter; '' for what is no letter."""
    got = _SCRIPTS.get(c)
    if got is None:
        n = ord(c)
        if c in "\u00aa\u00b5\u00ba" or not unicodedata.category(c).startswith(("L", "M")):
            got = ""
        elif n < 0x250 or 0x1E00 <= n < 0x1F00:
            got = "L"
        elif 0x370 <= n < 0x400 or 0x1F00 <= n < 0x2000:
            got = "G"
        elif 0x400 <= n < 0x530:
            got = "C"
        elif 0x2E80 <= n < 0xA000 or 0xF900 <= n < 0xFB00:
            got = "H"
        else:
            got = "K" if 0xAC00 <= n < 0xD7B0 else f"{n >> 8:x}"
        _SCRIPTS[c] = got
    return got


def _byte_of(codec: str) -> dict[str, int]:
    """Character → byte of a single-byte codec; bytes that it leaves out stand for the control characters of Latin-1."""
    if codec in _TABLES:
        return _TABLES[codec]
    out = _TABLES[codec] = {}
    for b in range(128, 256):
        try:
            c = bytes([b]).decode(codec)
        except UnicodeDecodeError:
            c = chr(b)
        out[c] = b
    return out


def _char_of(codec: str) -> dict[int, str]:
    return {b: c for c, b in _byte_of(codec).items()}


def undo(run: str, step: str) -> str:
    """A run of non-ASCII characters with one step undone, or the run itself where that isn't strictly possible."""
    key = (run, step)
    if key not in _UNDONE:
        if len(_UNDONE) > 200_000:
            _UNDONE.clear()
        _UNDONE[key] = _undo(run, step)
    return _UNDONE[key]


def _undo(run: str, step: str) -> str:
    wrong, true, _ = STEPS[step]
    if wrong in ("gbk", "big5"):
        return _undo_wide(run, wrong)
    table, back, new = _byte_of(wrong), _char_of(wrong), _char_of(true) if true != "utf-8" else None
    out: list[str] = []
    part = bytearray()

    def flush() -> bool:
        """What is left between whole characters must be signs: a letter left over means that these aren't the bytes."""
        if new is not None:
            out.append("".join(new[b] for b in part))
            part.clear()
            return True
        at = 0
        for m in _MULTI.finditer(part):
            left = "".join(back[b] for b in part[at : m.start()])
            try:
                good = m.group().decode("utf-8")
            except UnicodeDecodeError:
                return False
            if any(map(script, left)):
                return False
            out.append(left + good)
            at = m.end()
        left = "".join(back[b] for b in part[at:])
        out.append(left)
        part.clear()
        return not any(map(script, left))

    for c in run:
        b = table.get(c)
        if b is not None:
            part.append(b)
        elif script(c) or not flush():
            return run
        else:
            out.append(c)
    return "".join(out) if flush() else run


def _undo_wide(run: str, wrong: str) -> str:
    """As _undo, of two bytes a character: every stretch of letters decodes and reads back to itself, or nothing does."""
    out = []
    for part in re.split(r"(\ufffd+)", run):
        if not part or part[0] == "\ufffd":
            out.append(part)
            continue
        try:
            new = part.encode(wrong).decode("utf-8")
            if new.encode("utf-8").decode(wrong) != part:
                return run
        except UnicodeError:
            return run
        out.append(new)
    return "".join(out)


def apply(text: str, chain: tuple[str, ...]) -> str:
    """The text with a chain undone in every run that allows it; words that are sound in another script stay."""
    wide = chain[-1].startswith(("gbk", "big5"))

    def one(m: re.Match) -> str:
        run, (i, j) = m.group(), m.span()
        new = run
        for k, step in enumerate(chain):
            new = undo(new, step) if k == 0 else _RUN.sub(lambda x, step=step: undo(x.group(), step), new)
        if new == run:
            return run
        if not (i and text[i - 1].isalpha() or j < len(text) and text[j].isalpha()):
            scripts = {script(c) for c in run}
            if len(run) > 1 and len(scripts) == 1 and not scripts & {"", "L"}:  # a whole word of one other script
                after = {script(c) for c in new}
                if not chain[-1].endswith("utf-8") or not (after <= {"L"} or len(new) >= 4 and len(after) == 1 and "" not in after):
                    return run
        return run if wide and "\ufffd" in new and "\ufffd" not in run else new

    return _RUN.sub(one, text)


class Judge:
    """Description lengths by language, from word counts (lang → word → count)."""

    def __init__(self, words: dict[str, dict[str, int]]):
        self.dicts: dict[str, bytes] = {}
        counts: Counter[str] = Counter()
        odd: Counter[str] = Counter()
        for c in words.values():
            for w, x in c.items():
                for a, b in zip(" " + w, w, strict=False):
                    if b > "\x7f":
                        counts[_kind(a) + b] += min(x, 1000)
                        odd[b] += min(x, 1000)
        least = odd.total() * LEAST_KNOWN
        self.known = {c: 0x80 + i for i, (c, n) in enumerate(sorted(odd.items(), key=lambda x: (-x[1], x[0]))[:KNOWN]) if n >= least}
        for lang, c in sorted(words.items()):
            rng = random.Random(7)
            names, weights = list(c), [math.sqrt(x) for x in c.values()]
            samples = [self.code(" ".join(rng.choices(names, weights, k=14))) for _ in range(6000)]
            try:
                size = min(DICT_BYTES, max(2048, sum(map(len, names))))
                self.dicts[lang] = zstandard.train_dictionary(size, samples, level=LEVEL, k=48, d=6).as_bytes()
            except zstandard.ZstdError:  # too few words to train on: they are the dictionary as they stand
                self.dicts[lang] = self.code(" ".join(names))
        total = sum(counts.values()) + 1.0
        self.letters = {k: -math.log2(v / total) for k, v in counts.items()}
        self.rare = -math.log2(0.2 / total)
        self._forget()

    def _forget(self) -> None:
        self._tools: list | None = None
        self._words: dict[str, int] = {}
        self._chosen: dict[tuple[str, tuple[str, ...]], str] = {}

    def tools(self) -> list:
        if self._tools is None:
            self._tools = []
            for b in self.dicts.values():
                d = zstandard.ZstdCompressionDict(b)
                d.precompute_compress(level=LEVEL)
                self._tools.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))
        return self._tools

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("_tools", "_words", "_chosen")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def code(self, text: str) -> bytes:
        """The text in bytes that favour no script: ASCII and known characters one, others three or more."""
        if text.isascii():
            return text.encode()
        out = bytearray()
        for c in text:
            n = ord(c)
            if n < 128:
                out.append(n)
            elif (b := self.known.get(c)) is not None:
                out.append(b)
            elif n < 0xFF00:
                out += bytes((0xFF, n >> 8, n & 255))
            else:
                out += bytes((0xFF, 0xFF, n >> 16, n >> 8 & 255, n & 255))
        return bytes(out)

    def size(self, text: str) -> int:
        """Least compressed bytes over the languages."""
        raw = self.code(text)
        return min((len(t.compress(raw)) for t in self.tools()), default=len(raw))

    def word_size(self, word: str) -> int:
        """The same of a word on its own; kept, as words repeat."""
        got = self._words.get(word)
        if got is None:
            if len(self._words) > 300_000:
                self._words.clear()
            got = self._words[word] = self.size(f" {word} ")
        return got

    def letter_bits(self, word: str) -> float:
        """Code length of the non-ASCII letters of a word; capitals count as the small letters that they stand for."""
        if len(word) > 2 and word.isupper():
            word = word.lower()
        return sum(self.letters.get(_kind(a) + b, self.rare) for a, b in zip(" " + word, word, strict=False) if b > "\x7f")

    def undo_word(self, word: str, chain: tuple[str, ...]) -> str:
        """The word with the chain undone, if that makes it shorter by zstandard; by its letters where that can't tell."""
        key = (word, chain)
        got = self._chosen.get(key)
        if got is None:
            if len(self._chosen) > 300_000:
                self._chosen.clear()
            got = self._chosen[key] = self._undo_word(word, chain)
        return got

    def _undo_word(self, word: str, chain: tuple[str, ...]) -> str:
        new = apply(word, chain)
        if new == word:
            return word
        if word.upper() == word and new.upper() != new and len(word) > 2 and len(new) == len(word):
            return word  # a small letter inside capitals is no restoration
        gain = self.word_size(word) - self.word_size(new)
        return new if gain > 1 or gain >= -1 and self.letter_bits(new) < self.letter_bits(word) - 2 else word

    def restore(self, text: str) -> tuple[str, str, float, float, str] | None:
        """(restored text, chain, bits before, bits after, what decided), or None if the text stays as it is.

        Parts of a text may have gone through different chains, so what is left is judged again."""
        first = got = self._once(text)
        chains = []
        while got and len(chains) < 4:
            first = (got[0], "", first[2], got[3], first[4])
            chains.append(got[1])
            got = self._once(got[0])
        return (first[0], " + ".join(chains), *first[2:]) if first else None

    def _once(self, text: str) -> tuple[str, str, float, float, str] | None:
        words = [w for w in _WORD.findall(text) if _RUN.search(w)]
        if not words:
            return None
        uniq = list(dict.fromkeys(words))
        scripts = Counter(s for w in words for c in w if c > "\x7f" and (s := script(c)) not in ("", "L"))
        plain = sum(c < "\x7f" and c.isalpha() for c in text)
        before = letters = best = None
        tried = set()
        for chain in CHAINS:
            new = {w: x for w in uniq if (x := self.undo_word(w, chain)) != w}
            if not new or (key := tuple(new.items())) in tried:
                continue
            tried.add(key)
            if scripts:
                done = Counter(s for w in words if w in new for c in w if c > "\x7f" and (s := script(c)) not in ("", "L"))
                if any(2 * n < scripts[s] for s, n in done.items()):
                    continue
            if before is None:
                before, letters = self.size(text), sum(map(self.letter_bits, uniq))
            cost = sum(STEPS[s][2] for s in chain)
            to = _WORD.sub(lambda m, new=new: new.get(m.group(), m.group()), text)
            if not chain[-1].endswith("utf-8"):
                # a language that the corpus doesn't know, or hardly a Latin letter: letter for letter nothing can be told
                if any(c not in self.known and script(c) == "L" for c in to if c > "\x7f") or 2 * scripts.total() > plain:
                    continue
            gain = before - self.size(to) - cost
            lighter = letters - sum(self.letter_bits(new.get(w, w)) for w in uniq) - 8 * cost
            if best is None or (gain, lighter) > best[:2]:
                best = (gain, lighter, chain, to)
        if best is None or best[0] <= -1 or best[0] < 1 and best[1] <= 0:
            return None
        gain, _, chain, to = best
        return to, " ".join(chain), 8.0 * before, 8.0 * (before - gain), "zstd" if gain >= 1 else "letters"


def _kind(c: str) -> str:
    """What stands before a letter: b border, l lower case, u upper case, o other."""
    if c in " -'.’“":
        return "b"
    return "l" if c.islower() else "u" if c.isupper() else "o"


def fields_of(papers: DataFrame, fields: list[str]) -> DataFrame:
    """(paper_id, src_field, text) of the given fields; deliveries that are alike count once."""
    cols = [F.struct(F.lit(f).alias("src_field"), clean(f).alias("text")) for f in fields]
    rows = papers.select("paper_id", F.explode(F.array(*cols)).alias("x")).select("paper_id", "x.src_field", "x.text")
    return rows.filter("text is not null").distinct()


def word_counts(texts: DataFrame, names: DataFrame | None = None) -> dict[str, dict[str, int]]:
    """Words by language over all texts (text) and names (name); the most frequent of each language.

    Words of other scripts are a language of their own; texts without frequent words are names. A language's words are
    ranked in PARTS parts, each of which keeps as many as the whole may, so no task ranks a whole vocabulary."""
    words = F.split(F.col("text"), r"[\s,;|\"\[\]{}()/]+")
    frequent = sorted({w for ws in FUNCTION_WORDS.values() for w in ws.split()})
    scored = texts.select(words.alias("words"), F.array_intersect(F.split(F.lower("text"), r"[\s,;|\"\[\]{}()/]+"), F.array(*map(F.lit, frequent))).alias("hits"))
    scored = scored.select("words", *[F.size(F.array_intersect("hits", F.array(*map(F.lit, ws.split())))).alias(k) for k, ws in FUNCTION_WORDS.items()])
    top = F.greatest(*[F.col(k) for k in FUNCTION_WORDS])
    lang = F.coalesce(*[F.when((F.col(k) == top) & (top > 0), F.lit(k)) for k in FUNCTION_WORDS], F.lit("names"))
    all_ = scored.select(lang.alias("lang"), F.explode("words").alias("w"))
    if names is not None:
        all_ = all_.unionByName(names.select(F.lit("names").alias("lang"), F.explode(F.split("name", r"[\s,]+")).alias("w")))
    n = all_.filter(F.col("w") != "").groupBy("lang", "w").agg(F.count(F.lit(1)).alias("n")).filter(~F.col("w").rlike(_SUSPECT))
    n = n.withColumn("lang", F.when(F.col("w").rlike(_OTHER), F.lit("other")).otherwise(F.col("lang")))
    order = [F.desc("n"), F.asc("w")]
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("w"), F.lit(PARTS))).orderBy(*order))).filter(F.col("k") <= VOCABULARY)
    n = n.withColumn("k", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("k") <= VOCABULARY)
    out: dict[str, dict[str, int]] = defaultdict(dict)
    for r in n.select("lang", "w", "n").collect():
        out[r.lang][r.w] = out[r.lang].get(r.w, 0) + r.n
    return dict(out)


SCHEMA = "paper_id long, src_field string, original string, restored string, chain string, bits_before double, bits_after double, decided_by string, lost boolean"


def _judge(pdfs: Iterator[pd.DataFrame], judge: Judge) -> Iterator[pd.DataFrame]:
    for pdf in pdfs:
        out = []
        for pid, field, text in zip(pdf["paper_id"], pdf["src_field"], pdf["text"], strict=True):
            lost = "�" in text
            r = judge.restore(text)
            if r:
                out.append((pid, field, text, *r, lost))
            elif lost:
                out.append((pid, field, text, None, None, None, None, None, True))
        yield pd.DataFrame(out, columns=["paper_id", "src_field", "original", "restored", "chain", "bits_before", "bits_after", "decided_by", "lost"])


def garbled(papers: DataFrame, persons: DataFrame | None = None, fields: tuple[str, ...] = ("title", "abstract", "authors")) -> DataFrame:
    """The garbled fields, with the restored text where it can be had (SCHEMA).

    restored is NULL where characters are lost and nothing else can be undone. NULL, empty and None texts are never
    garbled; very long texts are judged whole, by their distinct words."""
    rows = fields_of(papers, list(fields))
    judge = Judge(word_counts(rows.select("text"), persons.select("name").distinct() if persons is not None else None))
    odd = rows.filter(F.col("text").rlike(r"[^\x00-\x7F]"))
    return odd.mapInPandas(lambda it: _judge(it, judge), SCHEMA)
