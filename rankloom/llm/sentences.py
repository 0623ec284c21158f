"""Sentence boundaries across languages and scripts.

Every character is mapped to its class of the standard property Sentence_Break, so a
text becomes a string of classes, and the standard's rules SB3 to SB11 are read off that
string: a terminator of any script with the closing marks behind it ends a sentence,
unless a letter or number follows at once (SB6, SB7), a small letter comes next (SB8) or
a mark that continues the sentence (SB8a). Three tailorings that the standard allows are
laid over them: abbreviations of the languages of the block suppress a boundary;
quotations and brackets, matched by a stack at any length, keep theirs inside; and lines
are read first, so that blank lines, list markers, headings and lines that stand alone
bound a unit while a mere line wrap doesn't. Thai has no terminators; there a space
between two Thai letters separates sentences.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_right
from collections.abc import Iterator
from statistics import median

import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Abbreviations after which a sentence goes on, whatever follows. "all": used in every language.
_ALWAYS = {
    "all": "mr mrs ms e.g i.e vs cf viz al fig figs vol vols pp dr prof ed eds jan feb apr jun jul aug sep sept oct nov dec ca app ref max min p no nos",
    "en": "sec secs eq eqs ch chap tab refs approx resp incl mr mrs ms st univ gen rev hon sgt col capt lt gov sen rep pres messrs mt ft dept ver lat avg est ex mar",
    "de": "tab z.b u.a d.h i.d.r bzw vgl abb s nr bd hrsg bspw sog ggf evtl inkl zzgl mio mrd str kap anm tel u.ä o.ä v.a z.t s.o s.u i.a m.e n.chr v.chr hr fr st bzgl max min",
    "fr": "p.ex env éd éds art chap fasc janv févr avr juil déc mme mlle mm m st",
    "es": "p.ej ej aprox núm núms cap caps pág págs sr sra srta sres dra ud uds ene abr ago dic véase tel ee art",
    "ru": "см рис табл проф др.проф акад доц напр ок т.е т.н т.к тыс млн млрд стр гл разд прим янв февр мар апр июн июл авг сент окт нояб дек им ул",
    "hi": "डॉ प्रो श्री पं",
}
# Abbreviations that may also end a sentence; a capital, a digit or an opening mark after them starts a new one.
_MAYBE = {
    "all": "etc inc corp ltd co jr ph.d u.s u.k u.n e.u a.m p.m b.c a.d d.c",
    "de": "usw uvm ff u.s.w e.v",
    "es": "uu",
    "ru": "т.д т.п и.т.д др пр г гг в вв",
    "en": "",
    "fr": "",
    "hi": "",
}
# Frequent words that tell the language of a text in Latin letters.
_TELLING = {
    "en": "the of and to in is that for with are this we was by on not as from which it",
    "de": "der die das und ist nicht ein eine mit auf für von den dem des sich auch werden wird im zu es",
    "fr": "le la les des est et une un dans pour que qui sur pas ne avec par du ce sont en il",
    "es": "el la los las de que y en un una es por con no para se del al como su más",
}
# Abbreviations before a number only; elsewhere they are words or units.
_NUMBER_ONLY = frozenset("no p s m art max min lat sun sat mar dec ed eds ex app tab str tel cap".split())
# Words before a day or an ordinal in German.
_ORDINAL_BEFORE = frozenset("der die das den dem des am im vom zum bis ab seit zur beim ein eine einer einem einen".split())

#: Letters of the classes of Sentence_Break. Closing marks are split: q closes, k opens.
_PROPERTIES = [(regex.compile(rf"\p{{Sentence_Break={name}}}"), letter) for name, letter in (
    ("CR", "r"), ("LF", "n"), ("Sep", "p"), ("Extend", "x"), ("Format", "x"), ("Sp", "s"), ("Lower", "l"), ("Upper", "u"), ("OLetter", "o"),
    ("Numeric", "d"), ("ATerm", "a"), ("STerm", "t"), ("SContinue", "c"), ("Close", "q"),
)]


class _Classes(dict):
    """Class of each code point, looked up as it comes; at most one entry a code point."""

    def __missing__(self, code: int) -> str:
        c = chr(code)
        letter = next((x for p, x in _PROPERTIES if p.match(c)), ".")
        if letter == "q" and unicodedata.category(c) in ("Ps", "Pi") and c != "“":
            letter = "k"
        elif c == "…":
            letter = "a"  # an ellipsis is read like the full stops that it stands for
        elif c in "។៕":
            letter = "t"
        elif letter == "." and c.isspace():
            letter = "s"
        self[code] = letter
        return letter


_CLASSES = _Classes()
_END = re.compile("[at][atx]*(q[qx]*)?")
# French sets its marks apart: « Est-ce assez ? » and « fragile. »
_SPACED_CLOSE = re.compile("[   ]»")
_QUOTES = re.compile("[“”„«»「」『』()（）\\[\\]‘’\"]")
_CLOSED_BY = {"”": "“„", "»": "«", "」": "「", "』": "『", ")": "(", "）": "（", "]": "[", "’": "‘"}
_MARKER = re.compile(r"[^\S\n]*(?:[-–—•*·‣◦▪●○]|\(?\d{1,3}[.)]|\(?(?:[a-zA-Z]|[ivxIVX]{1,4})\)|（\d{1,3}）|\d{1,2}[、．])[^\S\n]+\S")
_NUMBERED = re.compile(r"[^\S\n]*\(?\d{1,3}[.)]\s")
_LINE = re.compile("\r\n|[\n\r\x0b\x0c\x85  ]")
_THAI = re.compile(r"(?<=[ก-๛])\s+(?=[ก-๛])")
#: Read from right to left: the word or the letters with full stops that end at a place.
_WORD_BEFORE = regex.compile(r"(?r)(?<!\w)(?:[^\W\d_]\.[   ]?){1,4}[^\W\d_]{1,2}|(?<!\w)(?:[^\W\d_]\.){1,4}[^\W\d_]+|[^\W_]+|[ऀ-ॿ]+")
_NUMBER_BEFORE = regex.compile(r"(?r)([^\W\d_]+)[\s ]+\d{1,2}")
_YEAR_BEFORE = regex.compile(r"(?r)[\dIVX][\s ]*\w+")
_LATIN_WORDS = re.compile("[^\\W\\d_]+")
_OPENERS = "\"'“‘«„‹([{「『（［【〈《〔¿¡—–-…   "
_BREAKING = "。！？｡．।॥؟۔"


def _lists(table: dict[str, str], languages: frozenset[str]) -> frozenset[str]:
    return frozenset(w for lang in ("all", *languages) for w in table[lang].split())


_LANGUAGES = {w: [lang for lang, ws in _TELLING.items() if w in ws.split()] for words in _TELLING.values() for w in words.split()}
_CYRILLIC, _DEVANAGARI = re.compile("[а-яА-Я]{3}"), re.compile("[ऀ-ॿ]")
_PER_SET: dict[frozenset[str], tuple[frozenset[str], frozenset[str]]] = {}


def abbreviations(languages: frozenset[str]) -> tuple[frozenset[str], frozenset[str]]:
    """(always, maybe): the abbreviations of these languages and of all."""
    if languages not in _PER_SET:
        _PER_SET[languages] = _lists(_ALWAYS, languages), _lists(_MAYBE, languages)
    return _PER_SET[languages]


def languages_of(text: str, classes: str, declared: str | None) -> frozenset[str]:
    """Languages whose abbreviations count in the text.

    The script or the frequent words decide, for a text may mix languages and what is
    declared may be wrong; a language with a tenth of the winner's words counts too.
    The declared language stands in where nothing else tells, all languages where that
    is missing too.
    """
    found = set()
    if not text.isascii():
        if _CYRILLIC.search(text):
            found.add("ru")
        if _DEVANAGARI.search(text):
            found.add("hi")
    votes = dict.fromkeys(_TELLING, 0)
    if "l" in classes:
        for langs in filter(None, map(_LANGUAGES.get, _LATIN_WORDS.findall(text.lower()))):
            for lang in langs:
                votes[lang] += 1
    top = max(votes.values())
    found |= {lang for lang, n in votes.items() if n and 10 * n >= top}
    if not found:
        code = (declared or "").lower().replace("_", "-").split("-")[0]
        found = {code} if code in _ALWAYS else set(_ALWAYS) - {"all"}
    return frozenset(found)


class _Text:
    """A text with its classes and what its languages are."""

    def __init__(self, text: str, declared: str | None):
        self.text, self.classes = text, text.translate(_CLASSES)
        languages = languages_of(text, self.classes, declared)
        self.always, self.maybe = abbreviations(languages)
        self.german = "de" in languages

    def word_before(self, low: int, dot: int) -> str:
        """The folded word or lettered abbreviation that ends at ``dot``, without the white space in it."""
        found = _WORD_BEFORE.match(self.text, low, dot)
        word = found.group().lower() if found else ""
        if not word.isalnum():
            word = _WHITE.sub("", word)
        return word if word.isascii() else _AFTER_UNSPACED.sub("", word)


class _Block:
    """What the rules need to know of one block while its terminators are visited in order."""

    def __init__(self, whole: _Text, a: int, b: int):
        self.whole, self.stop, self.start = whole, b, a
        part = whole.classes[a:b]
        self.caseless = part.count("o") > part.count("l") + part.count("u")
        self.seen, self.run, self.odd = a, a, False  # how far it is read, where the last run without white space begins, whether that is an address or number

    def read_to(self, dot: int) -> None:
        """Find the run of characters without white space before ``dot``, and whether it is an address or a number."""
        text, low = self.whole.text, self.seen
        gap = max(text.rfind(" ", low, dot), text.rfind("\n", low, dot))
        if gap >= 0:
            low = self.run = gap + 1
            self.odd = False
        for m in _RUN_MARK.finditer(text, low, dot):
            if m.group().isspace():
                self.run, self.odd = m.end(), False
            else:
                self.odd = True
        self.seen = dot

    def goes_on(self, dot: int, end: int, after: int) -> bool:
        """Whether the sentence continues at ``after`` in spite of the terminators at ``dot`` (closing marks up to ``end``)."""
        text, classes, stop = self.whole.text, self.whole.classes, self.stop
        marks = text[dot:end]
        first = marks[0]
        nxt = after
        while nxt < stop and (text[nxt] in _OPENERS or text[nxt].isspace()):
            nxt += 1
        head, kind = (text[nxt], classes[nxt]) if nxt < stop else ("", "")
        gap, closed = after > end, classes[end - 1] in "qx" and marks[-1] != first
        closed = closed and classes[end - 1] == "q"
        small = kind == "l"
        if first in ".…" and not gap and not closed:
            # SB6, SB7: a number, an address, a file name; or a missing space between two sentences.
            here = text[end] if end < stop else ""
            if len(marks) > 1 or first == "…":
                return not (here.isupper() or (here and here in _OPENERS and head.isupper()))
            self.read_to(dot)
            plain = dot - self.run > 2 and text[dot - 2 : dot].isalpha() and text[dot - 2 : dot].islower() and not self.odd
            return not (plain and here.isupper())
        if kind == "c" and unicodedata.category(head) != "Pd" or head and head in "；)]}）":  # SB8a
            return True
        caseless = self.caseless or classes[dot - 1 : dot] == "o"
        if closed and not gap and head:
            if first in "?!？！؟" and caseless:
                return True  # a quoted question or call, and its sentence goes on
            if marks[-1] in "」』" and "぀" <= head <= "ゟ":
                return True
            if marks[-1] in "\"'" and "가" <= head <= "힯":
                return True
        if closed and first in "?!？！؟" and marks[-1] not in ")）]" and caseless:
            return True
        if first in _BREAKING:
            return False
        if classes[dot] == "t":  # SB11, but a small letter goes on where the script has them
            return small and (first in "!?‼⁇⁈⁉" or first in "‽⸮⸼⹓⹔")
        if "!" in marks or "?" in marks:
            return small
        if first == "…" or marks.startswith(".."):
            return small or (bool(head) and "㐀" <= head <= "鿿")
        return self.full_stop(dot, nxt, head, kind, gap, closed)

    def full_stop(self, dot: int, nxt: int, head: str, kind: str, gap: bool, closed: bool) -> bool:
        """SB8 and the abbreviations, for a single full stop."""
        text, stop, small = self.whole.text, self.stop, kind == "l"
        inner_capital = small and bool(_INNER_CAPITAL.match(text, nxt, stop))
        if closed:
            return small and not inner_capital
        word = self.whole.word_before(self.start, dot)
        tail = word.rsplit(".", 1)[-1]
        before = text[dot - 1] if dot > self.start else " "
        always, maybe = self.whole.always, self.whole.maybe
        if len(word) == 1 and before.isupper():
            return True
        if word in maybe or (tail in maybe and "." not in word):
            if tail in ("г", "гг", "в", "вв") and not _YEAR_BEFORE.match(text, self.start, dot):
                return True
            return small or head.isdigit() and tail not in ("etc", "usw")
        if tail in _NUMBER_ONLY and tail in always and "." not in word and not before.isupper():
            return small or (head.isdigit() and tail not in ("s", "m"))
        if word in always or (len(tail) > 1 and tail in always):
            return True
        if len(tail) == 1 and tail.isalpha():
            if _LETTER_DOT.match(text, nxt, stop):
                return True  # an abbreviation of several letters with spaces between
            # An initial, unless it is the last word of a longer run in a script without case.
            return before.isupper() or self.whole.classes[dot - 1] == "o" or small
        if tail.isdigit():
            if len(tail) <= 2 and head.isupper() and self.whole.german:
                prev = _NUMBER_BEFORE.match(text, self.start, dot)
                if prev and prev.group(1).lower() in _ORDINAL_BEFORE:
                    return True
            return small and not inner_capital and not gap
        if small:
            return not (inner_capital or (len(tail) >= 4 and tail.isascii() and not _TWO_SMALL_WORDS.match(text, nxt, stop)))
        return False


_LETTER_DOT = re.compile(r"[^\W\d_]\.")
_RUN_MARK = re.compile(r"\s|[/@\\]|(?<=\w)\.(?=\w)")
_WHITE, _AFTER_UNSPACED = re.compile(r"\s"), re.compile(r"^.*[぀-鿿가-힯](?=[a-z])")
_INNER_CAPITAL = re.compile(r"[a-z]+[A-Z]|[a-z]+-[a-z]")
_TWO_SMALL_WORDS = re.compile(r"[a-z]+ [a-z]")


def _matched_marks(text: str, a: int, b: int) -> tuple[list[int], list[int], set[int]]:
    """(begins, ends) of the outermost quotations and brackets between ``a`` and ``b``, and the ends of all.

    One stack, one pass, any length. A mark that nothing closes is passed over.
    """
    stack: list[tuple[str, int]] = []
    spans = []
    for m in _QUOTES.finditer(text, a, b):
        c, at = m.group(), m.start()
        before = text[at - 1] if at > a else " "
        behind = text[at + 1] if at + 1 < b else " "
        wants = _CLOSED_BY.get(c)
        if c == "’" and before.isalnum() and behind.isalnum():
            continue  # an apostrophe
        if c == "“" and any(o == "„" for o, _ in stack):
            wants = "„"
        if c == '"':
            opened = any(o == c for o, _ in stack)
            if opened:
                wants = c
            elif behind.isspace() or not (before.isspace() or before in "([（[—-" or "ऀ" <= before <= "ॿ" or "぀" <= before <= "鿿" or "가" <= before <= "힯"):
                continue
        if wants is None:
            stack.append((c, at))
            continue
        for k in range(len(stack) - 1, -1, -1):
            if stack[k][0] in wants:
                spans.append((stack[k][1], at + 1))
                del stack[k:]
                break
    outer: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if not outer or s >= outer[-1][1]:
            outer.append((s, e))
    return [s for s, _ in outer], [e for _, e in outer], {e for _, e in spans}


def _closed(line: str, classes: str) -> bool:
    """Whether the line ends in a terminator, a colon or a semicolon, closing marks aside."""
    n = len(line)
    while n and (classes[n - 1] in "qxs"):
        n -= 1
    return bool(n) and (classes[n - 1] in "at" or line[n - 1] in ":：;；")


def _wrapped(line: str, nxt: str, width: float) -> bool:
    """Whether ``line`` was merely broken before ``nxt``, whose first word wouldn't have fitted into the width of its paragraph."""
    head = re.match(r"\S+", nxt)
    return NARROW <= min(width, len(line)) and max(width, len(line) / 1.3) <= WIDE and len(line) + 1 + (len(head.group()) if head else 0) >= width


#: Narrower lines are headings and lists, wider ones aren't broken to a width; the width taken for paragraphs of up to three lines.
NARROW, WIDE, USUAL = 50, 100, 68.0


def _blocks(whole: _Text) -> Iterator[tuple[int, int]]:
    """Begin and end of the runs of lines that are one piece of running text."""
    text = whole.text
    lines, low = [], 0
    for m in _LINE.finditer(text):
        lines.append((low, m.start()))
        low = m.end()
    lines.append((low, len(text)))
    if len(lines) == 1:
        if text.strip():
            yield 0, len(text)
        return
    widths, k = [0.0] * len(lines), 0
    while k < len(lines):  # the usual width of each run of lines without a blank one, its last line aside
        j = k
        while j < len(lines) and text[lines[j][0] : lines[j][1]].strip():
            j += 1
        widths[k:j] = [median(b - a for a, b in lines[k : j - 1]) if j - k > 3 else USUAL] * (j - k)
        k = j + 1
    begin = end = -1
    item, last = False, (0, 0)
    for (a, b), width in zip(lines, widths):
        line = text[a:b]
        bare = line.strip()
        if not bare:
            if begin >= 0:
                yield begin, end
            begin = -1
            continue
        marked = bool(_MARKER.match(line))
        if begin >= 0:
            above = text[last[0] : last[1]].rstrip()
            low = last[0] + len(above) - len(above.lstrip())
            size = len(above.strip())
            high = last[0] + len(above)
            closed = _closed(above, whole.classes[last[0] : high])
            short = whole.word_before(low, high - 1) if above.endswith(".") else ""
            if short and (short in whole.always or (len(short) == 1 and above[-2].isupper())) and size >= 30:
                joined = True  # an abbreviation at the end of the line
            elif above[-1] in ",;" and not item:
                joined = True
            elif marked:
                final = _FINAL_WORD.search(above)
                joined = bool(whole.german and final and final.group().lower() in _ORDINAL_BEFORE and _NUMBERED.match(line) and size >= 30)
            elif bare[0].islower():
                joined = True
            elif closed:
                joined = not item
            else:
                joined = not item and _wrapped(above.strip(), bare, width)
            if not joined:
                yield begin, end
                begin = -1
        if begin < 0:
            begin, item = a, marked
        end, last = b, (a, b)
    if begin >= 0:
        yield begin, end


_FINAL_WORD = re.compile(r"[^\W\d_]+$")


def _split_block(whole: _Text, a: int, b: int) -> Iterator[tuple[int, int]]:
    """Sentences between ``a`` and ``b``, trimmed of white space."""
    text, classes = whole.text, whole.classes
    begins, ends, every_end = _matched_marks(text, a, b)

    def inside(at: int) -> bool:
        k = bisect_right(begins, at - 1) - 1
        return k >= 0 and at < ends[k]

    marker = _MARKER.match(text, a, b)
    begin, first = a, (marker.end() - 1 if marker else a)
    cuts: list[int] = []
    state = _Block(whole, a, b)
    for m in _END.finditer(classes, first, b):
        dot, end = m.start(), m.end()
        if m.group(1):
            # Marks that open rather than close aren't part of this sentence.
            while end > m.start(1) and text[end - 1] in "\"“'" and end not in every_end:
                end -= 1
        if (s := _SPACED_CLOSE.match(text, end, b)) and s.end() in every_end:
            end = s.end()
        if end >= b or inside(end):
            continue
        after = end
        while after < b and text[after].isspace():
            after += 1
        if after >= b or state.goes_on(dot, end, after):
            continue
        cuts.append(end)
    for m in _THAI.finditer(text, a, b):
        if not inside(m.start()):
            cuts.append(m.start())
    for cut in [*sorted(cuts), b]:
        lo, hi = begin, cut
        while lo < hi and text[lo].isspace():
            lo += 1
        while hi > lo and text[hi - 1].isspace():
            hi -= 1
        if lo < hi:
            yield lo, hi
        begin = cut


def split_text(text: str | None, lang: str | None = None) -> list[tuple[int, int]]:
    """(begin, end) of each sentence in code points; none for null, empty and blank texts.

    ``lang`` only counts where neither script nor frequent words tell the language.
    """
    out: list[tuple[int, int]] = []
    if text:
        whole = _Text(text, lang)
        for a, b in _blocks(whole):
            out += _split_block(whole, a, b)
    return out


def sentences(documents: DataFrame) -> DataFrame:
    """(doc_id, begin_at, end_at) of each sentence of each text, in code points, end exclusive.

    Sentences don't overlap and cover every character but white space. Narrow: one
    Arrow-batched pass over whole texts, no shuffle. Null, empty and blank texts have
    none. ``lang`` may be missing, null or wrong.
    """

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for batch in batches:
            for low in range(0, batch.num_rows, 256):
                part = batch.slice(low, 256)
                rows, begins, ends = [], [], []
                for i, (text, lang) in enumerate(zip(part.column(1).to_pylist(), part.column(2).to_pylist())):
                    for b, e in split_text(text, lang):
                        rows.append(i)
                        begins.append(b)
                        ends.append(e)
                ids = part.column(0).take(pa.array(rows, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.array(begins, pa.int32()), pa.array(ends, pa.int32())], ["doc_id", "begin_at", "end_at"]
                )

    schema = T.StructType(
        [
            T.StructField("doc_id", documents.schema["doc_id"].dataType),
            T.StructField("begin_at", T.IntegerType()),
            T.StructField("end_at", T.IntegerType()),
        ]
    )
    lang = F.col("lang") if "lang" in documents.columns else F.lit(None).cast("string")
    return documents.select("doc_id", "text", lang.alias("lang")).mapInArrow(run, schema)
