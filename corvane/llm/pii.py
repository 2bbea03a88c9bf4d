"""Personal data: e-mail addresses, IP addresses, card and phone numbers, also where they are disguised.

Base spans come from fixed patterns on the text as it is. Then transducers rewrite the text: homoglyphs and invisible
characters and digits of other scripts to plain ASCII, spelled digits to digits, and "at" / "dot" disguises to @ and full
stops. Each keeps, for every character it writes, the source characters it stands for. The same detectors run on the
result, and what they find is mapped back to source offsets and added where no base span of that kind lies, or where it
reaches beyond the base spans it covers. Offsets are code points, ends exclusive.

Every pattern is bounded or reads on from where it stopped, so a text takes time in proportion to its length.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.cluster import session_for_texts

KINDS = ("email", "ip", "card", "phone")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match starts at the first digit of its run: a later start in the same run would have the same continuation.
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_TO_DIGITS = {c: None for c in range(128) if not 48 <= c <= 57}

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if k % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def detect(text: str) -> list[Span]:
    """(start, kind index, end) of every match, leftmost and non-overlapping within a kind; linear in the text."""
    found: list[Span] = []
    at = text.find("@")
    last = 0
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            found.append((start, 0, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = max(last, at + 1)  # a local part has no @ in it
            at = text.find("@", at + 1)
    if _DIGIT.search(text):
        for m in _IP.finditer(text):
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m[0].split(".")):
                found.append((m.start(), 1, m.end()))
        for m in _CARD.finditer(text):
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), 2, m.end()))
        if "+" in text:
            for m in _PHONE.finditer(text):
                if 9 <= len(m[0].translate(_TO_DIGITS)) <= 15:
                    found.append((m.start(), 3, m.end()))
    return sorted(found)


# Letters of other scripts that look like the ASCII letter below them.
_LOOKALIKE = dict(
    zip(
        "АВЕКМНОРСТХаеорсухіјѕԁɡһⅼոսΑΒΕΖΗΙΚΜΝΟΡΤΥΧονριІЈЅ",
        "ABEKMHOPCTXaeopcyxijsdghlnuABEZHIKMNOPTYXovpiIJS",
        strict=True,
    )
)
#: Soft hyphen, zero-width characters, word joiner and byte order mark: they vanish.
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
#: The first digit of each script's ten, ASCII left out.
_ZEROS = [c for c in map(chr, range(128, 0x20000)) if c.isdecimal() and unicodedata.digit(c) == 0]
_ODD = re.compile(f"[{_INVISIBLE}ɡͰ-ԯոս\u2000-\u206f℀-ⅿ①-⓿！-～\U0001d400-\U0001d7ff{''.join(f'{c}-{chr(ord(c) + 9)}' for c in _ZEROS)}]")
# The spelled digits.
_SPELLED = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_WORD = "|".join(_SPELLED)
#: A digit word or number, and what may stand between two of them: spaces, hyphens, a comma.
_TOKEN, _BETWEEN = rf"(?:(?:{_WORD})(?![A-Za-z0-9])|[0-9]++(?![A-Za-z]))", r"(?:, ?|[ -]{1,3})"
#: Digit words and numbers in a row, from first to last: what follows a run is no part of another, so a text is read once.
_RUN = re.compile(rf"(?<![A-Za-z0-9])(?:plus[ -]{{1,3}})?{_TOKEN}(?:{_BETWEEN}{_TOKEN})++", re.I)
_RUN_PART = re.compile(rf"plus[ -]{{1,3}}|(?:{_WORD})(?![A-Za-z0-9])|, ?|[ -]{{2,3}}|[0-9]++", re.I)
# Fixed values: "dot" and "at" in English, German, French and Spanish.
_DOTS, _ATS = "dot|punkt|point|punto", "at|arobase|arroba|klammeraffe"
_DOT = rf"\s{{0,3}}[\[({{<]\s{{0,2}}(?:{_DOTS}|\.)\s{{0,2}}[\])}}>]\s{{0,3}}|\s{{1,3}}(?:{_DOTS})\s{{1,3}}|_(?:{_DOTS})_"
_AT = rf"\s{{0,3}}[\[({{<]\s{{0,2}}(?:{_ATS}|@)\s{{0,2}}[\])}}>]\s{{0,3}}|_(?:{_ATS})_|\s{{1,3}}(?:arobase|arroba|klammeraffe)\s{{1,3}}"
# Last labels after which a bare "at" and a bare "dot" are believed.
_LAST = "com|org|net|edu|gov|mil|int|info|biz|io|co|ai|dev|app|me|tv|eu|uk|us|ca|au|de|fr|es|it|nl|be|ch|at|pl|se|no|fi|dk|pt|br|mx|in|jp|cn|ru|example|test"
# Words before an address that make a bare "at" and a plain full stop believed.
_CUE = "e-?mail|mail|contact|write|reach|kontakt|correo|courriel|adresse|address"
_NAME, _LABEL = r"[A-Za-z0-9.%+](?:(?!_(?:at|arobase|arroba|klammeraffe|dot|punkt|point|punto)_)[A-Za-z0-9._%+-]){0,63}", r"[A-Za-z0-9-]{1,63}"
#: A bracketed or joined "at" stands for @ before any domain; a bare one only if a "dot" is disguised before a known last
#: label, or after a cue, or where the name before it is no plain word.
_DISGUISED = re.compile(
    rf"(?<![A-Za-z0-9._%+-]){_NAME}(?:(?:{_DOT}){_NAME}){{0,3}}(?:(?:{_AT}){_LABEL}(?:(?:{_DOT}|\.){_LABEL})+|(?:\s{{1,3}}at\s{{1,3}}|@){_LABEL}(?:(?:{_DOT}|\.){_LABEL}){{0,4}}(?:{_DOT})(?:{_LAST})(?![A-Za-z0-9-]))|(?<![A-Za-z0-9._%+-]){_NAME}(?:(?:{_DOT}){_NAME}){{1,3}}@{_LABEL}(?:\.{_LABEL})+",
    re.I,
)
_BARE = re.compile(rf"(?:(?<![A-Za-z])(?:{_CUE})\b[ :]{{1,3}}(?:(?:to|me|us|is|at|an|a|à)\b[ :]{{1,3}})?[A-Za-z0-9._%+-]{{1,64}}|(?<![A-Za-z0-9._%+-])[A-Za-z0-9]{{1,32}}(?:[._+][A-Za-z0-9]{{1,32}}){{1,4}}|(?<![A-Za-z0-9._%+-])[A-Za-z]{{1,32}}[0-9]{{1,8}})(?P<at> at )[A-Za-z0-9-]{{1,63}}(?:\.[A-Za-z0-9-]{{1,63}}){{0,4}}\.(?:{_LAST})(?![A-Za-z0-9-])", re.I)
_DISGUISED_IP = re.compile(rf"(?<![0-9])[0-9]{{1,3}}(?:(?:{_DOT}|\.)[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
_DISGUISE = re.compile(rf"(?P<dot>{_DOT})|(?P<at>{_AT}|\s{{1,3}}at\s{{1,3}})", re.I)
_BRACKETED = re.compile(rf"[\[({{<]\s{{0,2}}(?:[.@]|(?:{_ATS}|{_DOTS})\b)", re.I)
_SPACED_DOT = re.compile(rf"[\s_](?:{_DOTS})[\s_]", re.I)
_AT_WORDS = ("arobase", "arroba", "klammeraffe", "_at_")
_AT_DOMAIN = re.compile(rf" at [a-z0-9-]{{1,63}}(?:\.[a-z0-9-]{{1,63}}){{0,4}}\.(?:{_LAST})(?![a-z0-9-])")
_DIGIT_WORD = re.compile(rf"(?<![a-z0-9])(?:{_WORD})(?:, ?|[ -]{{1,3}})(?:[0-9]|{_WORD})")


def _runs(text: str) -> Iterator[re.Match]:
    """Runs with a digit word that two tokens or more follow."""
    for m in _RUN.finditer(text):
        kinds = [p[0] for p in (x[0] for x in _RUN_PART.finditer(text, m.start(), m.end())) if p[0] not in " -," and not p.lower().startswith("plus")]
        if any(not k.isdigit() for k in kinds[:-2]):
            yield m


def _hints(text: str) -> set[str]:
    """Which transducers could fire: cheap tests, wide on the safe side."""
    low, found = text.lower(), set()
    if not text.isascii() and _ODD.search(text):
        return {"odd", "spelled", "disguised", "bare"}
    if _DIGIT_WORD.search(low):
        found.add("spelled")
    if any(b in low for b in "[({<") and _BRACKETED.search(low) or any(w in low for w in _AT_WORDS) or _SPACED_DOT.search(low):
        found.add("disguised")
    if _AT_DOMAIN.search(low):
        found.add("bare")
    return found


def _plain(c: str) -> str:
    if c in _INVISIBLE:
        return ""
    if c in _LOOKALIKE:
        return _LOOKALIKE[c]
    if c.isdecimal():
        return str(unicodedata.digit(c))
    folded = unicodedata.normalize("NFKC", c)
    return folded if len(folded) == 1 and folded.isascii() and folded.isprintable() else c


class Traced:
    """A text with, for each of its characters, the first and past-the-end source character."""

    def __init__(self, text: str) -> None:
        self.text, self.start, self.end = text, np.arange(len(text)), np.arange(1, len(text) + 1)

    def rewrite(self, edits: list[tuple[int, int, str]]) -> None:
        """Replace [start, end) by a string of one character or none, for each edit, in order."""
        if not edits:
            return
        text, start, end, at = [], [], [], 0
        for a, b, new in [*edits, (len(self.text), len(self.text), "")]:
            text.append(self.text[at:a])
            start.append(self.start[at:a])
            end.append(self.end[at:a])
            if new:
                text.append(new)
                start.append(self.start[a : a + 1])
                end.append(self.end[b - 1 : b])
            at = b
        self.text, self.start, self.end = "".join(text), np.concatenate(start), np.concatenate(end)


def normalised(text: str, hints: set[str]) -> Traced:
    """The text after all transducers that the hints name."""
    t = Traced(text)
    if "odd" in hints:
        t.rewrite([(m.start(), m.end(), new) for m in _ODD.finditer(text) if (new := _plain(m[0])) != m[0]])
    edits: list[tuple[int, int, str]] = []
    for run in _runs(t.text) if "spelled" in hints else ():
        for m in _RUN_PART.finditer(t.text, run.start(), run.end()):
            word = m[0].lower()
            if not word[0].isdigit():
                edits.append((m.start(), m.end(), "+" if word.startswith("plus") else _SPELLED.get(word, " ")))
    t.rewrite(edits)
    for whole in (_DISGUISED, _DISGUISED_IP) if "disguised" in hints else ():
        edits = []
        for run in whole.finditer(t.text):
            edits += [(m.start(), m.end(), "." if m["dot"] else "@") for m in _DISGUISE.finditer(t.text, run.start(), run.end())]
        t.rewrite(edits)
    if "bare" in hints:
        t.rewrite([(*m.span("at"), "@") for m in _BARE.finditer(t.text)])
    return t


def find(text: str) -> tuple[list[Span], list[Span]]:
    """Base spans, and the spans that only show once the text is normalised."""
    base = detect(text)
    if not (hints := _hints(text)):
        return base, []
    t = normalised(text, hints)
    if t.text == text:
        return base, []
    more = []
    known = [[(s, e) for s, k, e in base if k == kind] for kind in range(len(KINDS))]  # in order, none overlapping another
    for a, kind, b in detect(t.text):
        start, end = int(t.start[a]), int(t.end[b - 1])
        at = bisect_right(known[kind], (start, len(text) + 1)) - 1
        met = [p for p in known[kind][max(at, 0) : bisect_right(known[kind], (end - 1, len(text) + 1))] if p[1] > start]
        if not met or start <= met[0][0] and met[-1][1] <= end and (start, end) != met[0]:
            more.append((start, kind, end))
    return base, more


def written_out(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in sorted(spans))


def pii_spans(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id_col; n_email, n_ip, n_card, n_phone (base spans); base_sha256; spans (all, `kind:start:end` by start,
    then kind, joined by commas); n_added.

    Defined cases: null and empty texts have no spans (an empty string, and its hash). Rows are independent: repeated
    rows give repeated results, ids may be null, and only the named columns are read. Texts of any length are searched
    whole, in time linear in their length.
    """
    session_for_texts(documents.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts, shas, spans, added = np.zeros((4, batch.num_rows), np.int64), [], [], []
            for r, text in enumerate(batch.column(1)):
                base, more = find(text.as_py() or "")
                for _, kind, _ in base:
                    counts[kind, r] += 1
                shas.append(hashlib.sha256(written_out(base).encode()).hexdigest())
                spans.append(written_out(base + more))
                added.append(len(more))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c) for c in counts), pa.array(shas, pa.string()), pa.array(spans, pa.string()), pa.array(added, pa.int64())], names=[id_col, "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans", "n_added"])

    rows = documents.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"))
    return rows.mapInArrow(run, f"`{id_col}` long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long")


def redact(text: str) -> str:
    """The text with every span, base or added, replaced by its kind in angle brackets; overlapping spans become one."""
    base, more = find(text)
    out, at, upto = [], 0, -1
    for s, k, e in sorted(base + more):
        if s >= upto:
            out += [text[at:s], f"<{KINDS[k].upper()}>"]
        upto = max(upto, e)
        at = upto
    return "".join([*out, text[at:]])


def with_pii_redacted(documents: DataFrame, text_col: str = "text") -> DataFrame:
    """All rows and columns, the text redacted; null stays null."""
    session_for_texts(documents.sparkSession)

    @F.arrow_udf("string")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            yield pa.array([None if (t := x.as_py()) is None else redact(t) for x in column], pa.string())

    return documents.withColumn(text_col, clean(F.col(text_col)))
