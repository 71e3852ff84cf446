"""Noise in text from scanned pages (problem 1).

An averaged-perceptron character editor decides on words: for each place of a word it weighs to keep the character against replacing,
deleting or inserting (the operations that the corpus shows), and for a word that ends a line whether to join it to the next. What it
weighs are features: the operation, the letters around it, and how often the word as it stands and the word that the operation makes
occur. An edit is made only if it scores above keeping. A second perceptron classes lines by page-position features (what stands
before and after, form feeds, repeats of titles, numbers at the ends) as running line or text.

Nothing is labelled, so the models label their own examples. Word counts over all documents (mid-line words only) tell which rare word
is a wrongly read form of a frequent one: the pairs teach which operations there are, and all listed words teach when to
make them. Compounds and cut words of the list teach the joins, titles that come again at page ends the line classifier. Stamps, lines whose
last number rises from page to page, are counted by their words over all documents. Training runs on the driver on bounded samples
(``PAIRS`` words, ``SAMPLE`` documents of at most ``SAMPLE_CHARS`` characters); counts and everything else cover all documents.

The word list that tasks need holds words of a document frequency of at least ``SHARE`` / 4 of the documents: there are at most
(mean distinct words a document) * 4 / SHARE of these, whatever the size of the corpus. It is broadcast after a check of its size.
"""

from __future__ import annotations

import difflib
import math
import re
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field, replace
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.perceptron import Perceptron, Ranker
from folioscope.llm.words import lcs
from folioscope.session import spread

#: Least share of documents of a word in the list that is broadcast, and the most words that it may have.
SHARE = 5e-4
MOST_WORDS = 2_000_000
#: How much more frequent the true word of a training pair must be.
RATIO = 20
#: Bounds of the training samples: documents whose lines are read, the longest of them, and words of each label.
SAMPLE = 1500
SAMPLE_CHARS = 200_000
PAIRS = 4000

_LETTERS = r"[^\W\d_]"
# A word; one that a line's end breaks, marked by a zero character, is none.
WORD = re.compile(rf"{_LETTERS}++(?:['’]{_LETTERS}++)*+(?:-{_LETTERS}++)*+(?!\0)")
_BROKEN = re.compile(r"[-¬\xad][ \t]*\r?\n[> \t]*[^\W\d_]+")
_MARKS = re.compile(r"^(?:[ \t]*>)+[ \t]*")
_HYPHEN = re.compile(r"([^\W\d_][\w'’-]*)[-¬\xad][ \t]*$")
_NUMBER = r"(?:[\dlIOoS|¢†]{1,5}|[ivxl]{1,7})"
# Shapes of a line with nothing but a page number.
_PAGE = re.compile(rf"^(?:(?:[Pp]\S{{1,3}}|[Pp]\.|[Ss]eite|[Ss]ide)\s*{_NUMBER}(?:\s*(?:of|0f|av|von|de|/)\s*{_NUMBER})?|{_NUMBER}\s*(?:of|0f)\s*{_NUMBER}|[-–—]\s*{_NUMBER}\s*[-–—]|\[{_NUMBER}\]|{_NUMBER})$")
_STAMP = re.compile(r"(.*[^\dOolI])([\dOolI]{4,})")
_END_NUMBER = re.compile(r"^(.*\S)\s{2,}([\dlIOoS|]{1,5}|[ivxl]{1,7})$")
_START_NUMBER = re.compile(r"^([\dlIOoS|]{1,5}|[ivxl]{1,7})\s{2,}(\S.*)$")
_HEADER = re.compile(r"^(?:From|Sent|To|Cc|Bcc|Date|Subject|Importance|Re|Von|An|Fra|Til|De|À)\s*:", re.I)
_SUBJECT = re.compile(r"^Subject:\s*(.*)$", re.I)
_REPLY = re.compile(r"^(?:(?:re|fwd?|aw|sv)\s*:\s*)+", re.I)
_DIGITS = str.maketrans({"O": "0", "o": "0", "l": "1", "I": "1"})
_DIGIT_LIKE = frozenset("0123456789OolI")
_EDGE = ".,;:!?\"'()[]{}<>«»„“”’‘…>"
# Signs that disguise words on purpose, not by misreading.
_ON_PURPOSE = set("$@*#%&=/\\~^+_<>")


def _plain(line: str) -> str:
    return line.replace("\r", "").replace("﻿", "").replace("\f", "")


def _stripped(line: str) -> str:
    """A line without blanks at its ends, carriage returns, form feeds and byte order marks."""
    s = line.strip()
    if s and (s[0] == "\ufeff" or "\f" in s or "\r" in s):
        s = _plain(s).strip()
    return s


def stamp_of(s: str) -> tuple[str, int] | None:
    """The words and the number of a line that may be the stamp of a sheet: a short line that ends in a number of four digits or more."""
    m = _STAMP.fullmatch(s) if len(s) <= 60 else None
    if not m or sum(c.isdigit() for c in m[2]) < 2:
        return None
    return re.sub(r"\s+", " ", m[1]).strip().lower(), int(m[2].translate(_DIGITS))


def rising_stamps(text: str) -> set[str]:
    """The words of stamps whose numbers rise, by twenty at most, from one to the next."""
    last, out = {}, set()
    for raw in text.split("\n"):
        if len(raw) <= 80 and raw.rstrip()[-1:] in _DIGIT_LIKE and (got := stamp_of(_stripped(raw))):
            words, n = got
            if words in last and 0 < n - last[words] <= 20:
                out.add(words)
            last[words] = n
    return out


def _same(title: str) -> str:
    """A title without case, reply marks and signs, and with runs of blanks as one."""
    return re.sub(r"\s+", " ", _REPLY.sub("", title.strip()).lower())


def line_features(lines: list[str], k: int, kinds: list[str]) -> list[str]:
    """Page-position features of line ``k``; ``kinds`` has what is known of the lines around it."""
    raw, s = lines[k], _stripped(lines[k])
    words = s.split()
    before = kinds[k - 1] if k else "start"
    after = kinds[k + 1] if k + 1 < len(kinds) else "end"
    nxt = _stripped(lines[k + 1]) if k + 1 < len(lines) else ""
    letters = [c for c in s if c.isalpha()]
    caps = sum(c.isupper() for c in letters) / max(len(letters), 1)
    at = "cap" if s[:1].isupper() else "low" if s[:1].islower() else "other"
    return [
        "bias",
        "before=" + before,
        "after=" + after,
        "around=" + before + "/" + after,
        "feed=" + str("\f" in raw),
        "caps=" + ("all" if caps > 0.9 else "some" if caps > 0.25 else "few"),
        "at=" + at,
        "at=" + at + before + after,
        "last=" + (s[-1:] if not s[-1:].isalnum() else "a"),
        "words=" + str(min(len(words), 12)),
        "first=" + (words[0].lower() if words else ""),
        "two=" + " ".join(words[:2]).lower(),
        "next=" + ("cap" if nxt[:1].isupper() else "low" if nxt[:1].islower() else "none" if not nxt else "other"),
        "mark=" + str(raw.lstrip()[:1] == ">"),
        "wide=" + str(len(s) > 0.85 * max((len(x) for x in lines[max(0, k - 8) : k + 9]), default=1)),
    ]


def known_kinds(lines: list[str], stamps: frozenset[str] = frozenset()) -> list[str]:
    """page_no, stamp (one of ``stamps``), blank, mark or text for each line, by its own shape."""
    out = []
    for raw in lines:
        s = _stripped(raw)
        if not s:
            out.append("blank")
        elif len(s) <= 16 and _PAGE.match(s) and (any(c.isdigit() for c in s) or s in "lI|" or re.fullmatch(r"[ivxl]+|.*\s[ivxlI|]+.*|\W+[ivxlI|]+\W+|[lI|]{1,3}\d*", s)):
            out.append("page_no")
        elif stamps and (got := stamp_of(s)) and got[0] in stamps:
            out.append("stamp")
        elif s[0] == ">":
            out.append("mark")
        else:
            out.append("text")
    return out


def titles_of(lines: list[str]) -> dict[str, int]:
    """What a running line may repeat, with its place: the first lines of a document and the subject of a mail."""
    out, n = {}, 0
    for k, raw in enumerate(lines[:40]):
        s = _stripped(raw)
        if not s:
            continue
        m = _SUBJECT.match(s)
        if m and m[1]:
            out.setdefault(_same(m[1]), k)
        n += 1
        if n <= 5 and not _HEADER.match(s) and 5 < len(s) < 110 and s[-1:] not in ".,:;-":
            out.setdefault(_same(s), k)
    return out


@lru_cache(maxsize=50_000)
def _alike(a: str, b: str) -> bool:
    """Equal, or with a few letters cut off or wrongly read."""
    if a == b:
        return True
    if min(len(a), len(b)) < 8 or abs(len(a) - len(b)) > 4:
        return False
    return a.startswith(b) or b.startswith(a) or 2 * lcs(a, b) > 0.88 * (len(a) + len(b))


def _bare(s: str) -> tuple[str, bool]:
    """A line without a page number set off from it by two blanks or more, and whether it had one."""
    m = _END_NUMBER.match(s)
    if m:
        return m[1], True
    m = _START_NUMBER.match(s)
    if m:
        return m[2], True
    return s, False


_TABLE = re.compile(r"\d[\d,]*\.\d\d$")


@dataclass
class Candidate:
    """A line that may be a running one, with what page-position and repeats say of it."""

    text: str
    numbered: bool
    tight: bool
    title: bool
    again: bool
    caps: bool

    def sure(self, k: int) -> bool:
        """Whether it teaches the classifier as a running line: a title that comes again, or a head with its page number."""
        t = self.text
        return self.title or self.numbered and len(t) > 6 and (t[0].isupper() or bool(_REPLY.match(t))) or self.tight and k > 3 and self.caps and t[-1] not in ",;:?!" and "," not in t[:-4]

    def features(self, k: int) -> list[str]:
        t = self.text
        up = t[0].isupper() or bool(_REPLY.match(t))
        end = t[-1] if t[-1] in ",;:?!." else "a"
        return [
            f"title={self.title}", f"numbered={self.numbered}{up}{len(t) > 6}", f"caps={self.caps}{self.tight}", f"again={self.again}{end}", f"tight={self.tight}{up}{k > 3}{end}",
            f"all={self.title}{self.numbered}{self.tight}{self.caps}", f"header={bool(_HEADER.match(t))}",
        ]


def candidates_of(lines: list[str], kinds: list[str]) -> dict[int, Candidate]:
    """Lines that stand beside a stamp, page number or form feed, or carry a number set off from them."""
    if len(lines) < 3:
        return {}

    def edge(k: int) -> bool:
        return 0 <= k < len(lines) and kinds[k] in ("stamp", "page_no")

    near = {e + d for e, kind in enumerate(kinds) if kind in ("stamp", "page_no") for d in (-2, -1, 1, 2)}
    rows = {}
    for k, kind in enumerate(kinds):
        if kind != "text" or not (k in near or "  " in lines[k] or "\f" in lines[k]):
            continue
        s = _stripped(lines[k])
        t, numbered = _bare(s) if "  " in s else (s, False)
        tight = "\f" in lines[k] or edge(k - 1) or edge(k + 1)
        loose = tight or (k + 2 < len(lines) and kinds[k + 1] == "blank" and edge(k + 2)) or (k >= 2 and kinds[k - 1] == "blank" and edge(k - 2))
        if (loose or numbered) and len(t) >= 4 and not _TABLE.search(t) and not re.match(r"^\d{1,3}[.)]", t):
            rows[k] = (t, numbered, tight)
    if not rows:
        return {}
    titles = titles_of(lines)
    again = Counter(_same(t) for t, _, tight in rows.values() if tight)
    out = {}
    for k, (t, numbered, tight) in rows.items():
        same = _same(t)
        letters = [c for c in t if c.isalpha()]
        caps = sum(c.isupper() for c in letters) > 0.85 * max(len(letters), 1) and len(t.split()) >= 3
        title = any(at < k and _alike(same, x) for x, at in titles.items()) and (numbered or not _HEADER.match(_stripped(lines[k - 1])))
        out[k] = Candidate(t, numbered, tight, title, again[same] > 1, caps)
    return out


def running(lines: list[str], kinds: list[str], model: Perceptron | None = None) -> set[int]:
    """The places of running lines: stamps, and candidates that the line classifier takes for such; without one, those that are sure."""
    out = {k for k, kind in enumerate(kinds) if kind == "stamp"}
    for k, c in candidates_of(lines, kinds).items():
        if c.sure(k) if model is None else _runs(model, lines, k, kinds, c):
            out.add(k)
    return out


def _runs(model: Perceptron, lines: list[str], k: int, kinds: list[str], c: Candidate) -> bool:
    """The classifier's verdict; where neither a title, a number nor capitals speak for a line, its first words must too."""
    features = line_features(lines, k, kinds)
    if model.best(features + c.features(k)) != "running":
        return False
    begins = model.scores([f for f in features if f.startswith(("two=", "first="))])
    return c.title or c.numbered or c.caps or begins.get("running", 0.0) > begins.get("text", 0.0)


# ---------------------------------------------------------------- the character editor


def edit_features(word: str, k: int, seen: str, made: str) -> list[str]:
    """Features of one operation on ``word``: ``seen`` at place ``k`` becomes ``made``."""
    p = f"^^{word}$$"
    left, right = p[k : k + 2], p[k + 2 + len(seen) : k + 4 + len(seen)]
    op = f"{seen}>{made}"
    kind = "delete" if not made else "insert" if seen and seen in made else "replace"
    at = "begin" if k == 0 else "end" if k + len(seen) == len(word) else "mid"
    return [kind, kind + at, "o" + op, f"o{op}{at}", f"l{left[1]}{op}", f"r{op}{right[0]}", f"b{left[1]}{op}{right[0]}", f"w{left}{op}", f"x{op}{right}"]


def operations(seen: str, true: str) -> list[str]:
    """For each character of ``seen`` what makes ``true`` of it: keep, delete, replace by (=x) a text of one letter or more."""
    ops = ["keep"] * len(seen)
    for tag, a, b, c, d in difflib.SequenceMatcher(None, seen, true, autojunk=False).get_opcodes():
        if tag == "equal":
            continue
        if a == b:  # letters are missing: they come behind the character before
            k = max(a - 1, 0)
            ops[k] = "=" + (seen[k] + true[c:d] if a else true[c:d] + seen[k])
        else:
            ops[a] = "=" + true[c:d] if d > c else "delete"
            for k in range(a + 1, b):
                ops[k] = "delete"
    return ops


def apply_operations(seen: str, ops: list[str]) -> str:
    return "".join("" if o == "delete" else o[1:] if o[0] == "=" else c for c, o in zip(seen, ops, strict=True))


def _grade(x: float) -> int:
    """A share or ratio on a scale of half powers of two, from -40 to 40."""
    return max(-40, min(40, math.floor(2 * math.log2(x)))) if x > 0 else -40


@dataclass
class Model:
    """All that tasks need: word counts, the operations and the editor, the joiner, the line classifier and the stamps."""

    words: dict[str, int]
    documents: int
    editor: Ranker = field(default_factory=Ranker)
    confusions: dict[str, list[str]] = field(default_factory=dict)
    joiner: Ranker = field(default_factory=Ranker)
    lines: Perceptron | None = None
    stamps: frozenset[str] = frozenset()

    def __post_init__(self):
        self.floor = max(1.0, SHARE * self.documents)
        # A word of this frequency is not doubted; the commonest misread forms of the commonest words stay below it.
        self.shield = max(3.0, 0.01 * self.documents)
        self.known: dict[str, str | None] = {}
        self.tokens: dict[str, str | None] = {}
        self.longest = max(map(len, self.confusions), default=1)
        self.prefixes = {w[:k] for w in self.words for k in range(len(w) + 1)}
        self.signs = {a for a in self.confusions if len(a) == 1 and not a.isalpha()}

    def count(self, word: str) -> float:
        return self.words.get(word, 0)

    def own(self, word: str) -> float:
        """How often a word occurs as it stands; one that the list lacks counts as the rarest of it."""
        return max(self.count(word), self.floor * 0.25)

    def frequent(self, word: str) -> bool:
        return self.words.get(word, 0) >= self.shield

    def edits(self, word: str) -> list[tuple[str, list[tuple[int, str, str]]]]:
        """Listed words that operations make of ``word``, found along the list's prefixes: two operations (one in words of under five letters), and more
        as far as every five letters before bring one more. Of several ways to the same word that of the fewest operations is taken.
        """
        n, least, out = len(word), 2 if len(word) >= 5 else 1, {}
        level: dict[tuple[int, str], list[tuple[int, str, str]]] = {(0, ""): []}
        # By number of operations: each state (place, what was made) is reached first by the fewest.
        seen = set()
        while level:
            later: dict[tuple[int, str], list[tuple[int, str, str]]] = {}
            stack = list(level.items())
            while stack:
                (k, made), done = stack.pop()
                if (k, made) in seen:
                    continue
                seen.add((k, made))
                if k == n:
                    if done and made in self.words and made != word:
                        out.setdefault(made, done)
                    continue
                if made + word[k] in self.prefixes:
                    stack.append(((k + 1, made + word[k]), done))
                if len(done) < max(least, 1 + k // 5):
                    for length in range(1, min(self.longest, n - k) + 1):
                        for new in self.confusions.get(word[k : k + length], ()):
                            if made + new in self.prefixes:
                                later.setdefault((k + length, made + new), [*done, (k, word[k : k + length], new)])
            level = later
        return list(out.items())

    def keep_features(self, word: str) -> list[str]:
        n = len(word)
        return ["keep", f"keep{_grade(self.count(word) / max(self.documents, 1)) // 2}", f"keeplen{min(n, 8)}", f"keepsign{not word.isalpha()}"]

    def candidate_features(self, word: str, made: str, edits: list[tuple[int, str, str]]) -> list[str]:
        out = [f for k, a, b in edits for f in edit_features(word, k, a, b)]
        n = self.count(made)
        if not n:
            return [*out, "made=no"]
        ratio = _grade(n / self.own(word))
        ops = "+".join(sorted(f"{a}>{b}" for _, a, b in edits))
        out += [f"edits{len(edits)}", f"made{_grade(n / max(self.documents, 1)) // 2}", f"few{n < 2}", f"ratio{ratio}", f"{ops}ratio{ratio // 2}", f"edits{len(edits)}ratio{ratio // 2}"]
        # Steps of the ratio, so that what holds for one holds for all above it.
        return out + [f"ratio>={x}" for x in range(0, min(ratio, 20) + 1)]

    def choices(self, word: str) -> list[tuple[str, list[str]]]:
        """(what the word becomes, features), to keep it first. A sign in a word may be a misread letter though no listed word comes of it."""
        out = [(word, self.keep_features(word))]
        out += [(made, self.candidate_features(word, made, done)) for made, done in sorted(self.edits(word))]
        if any(c in self.signs for c in word):
            for k, c in enumerate(word):
                for new in self.confusions[c] if c in self.signs else ():
                    out.append((word[:k] + new + word[k + 1 :], self.candidate_features(word, "", [(k, c, new)])))
        return out

    def correct(self, word: str) -> str | None:
        """What the editor makes of a word (lower case), or None where keeping it scores highest."""
        if word in self.known:
            return self.known[word]
        if len(self.known) > 400_000:
            self.known.clear()
        got = None
        if len(word) > 1:
            choices = self.choices(word)
            if len(choices) > 1 and (at := self.editor.choose([f for _, f in choices])):
                got = choices[at][0]
        self.known[word] = got
        return got

    def misread(self, token: str) -> str | None:
        """The corrected token if it holds a wrongly read word, else None; answers are kept, as tokens come again."""
        got = self.tokens.get(token, "")
        if got == "":
            if len(self.tokens) > 400_000:
                self.tokens.clear()
            got = self.tokens[token] = self._misread(token)
        return got

    def _misread(self, token: str) -> str | None:
        core = token.strip(_EDGE).strip("-¬\xad").strip(_EDGE)
        if core.isalpha() and (len(core) < 3 or self.frequent(core.lower())):
            return None
        if len(core) == 2 and not core.isalpha() and any(c.isalpha() for c in core):
            made = self.correct(core.lower())
            return made if made and self.frequent(made) else None
        if len(core) < 3 or any(c in _ON_PURPOSE for c in core):
            return None
        low = core.lower()
        if self.frequent(low) or low != (one := unicodedata.normalize("NFKC", low)) and self.frequent(one):
            return None  # a ligature is no misread letter
        odd = not core.replace("-", "").replace("'", "").replace("’", "").isalpha()
        letters = sum(c.isalpha() for c in core)
        if odd:
            if letters < 2 or letters * 2 < len(core) or re.fullmatch(r"[\d.,:/+-]*(?:st|nd|rd|th|[AaPp][Mm]|[A-Za-z]{1,3}-\d+)?|.*\d\d.*", core):
                return None
        elif core[0].isupper() and not core[1:].islower() and not core.isupper():
            return self._mixed(core)
        if "." in core or "@" in core:
            return None
        if "-" in core:
            if core[0].isupper() and not core.isupper() and not odd:
                return None
            parts, made = core.split("-"), self.correct(low)
            if made:
                return made
            made = [p if self.frequent(p.lower()) or len(p) < 3 else self.correct(p.lower()) or p for p in parts]
            return "-".join(made) if made != parts and all(self.frequent(m.lower()) for m in made) else None
        return self.correct(low) if odd and core[0].isalpha() or len(core) > 3 or odd and self.edits(low) else None

    def _mixed(self, core: str) -> str | None:
        """Small l read for I within capitals."""
        if sum(c.isupper() for c in core) * 2 > len(core) and "l" in core and core.replace("l", "I").isupper():
            made = core.replace("l", "I").lower()
            return made if self.count(made) else core
        return None

    def join_features(self, left: str, right: str, sign: str, counted: bool = True) -> list[str]:
        """Features of joining a word that ends a line in a hyphen to the next line's first word; without counts of the whole if not ``counted``."""
        l, r = left.lower(), right.lower()
        out = ["join", "sign" + sign, f"left{min(len(l), 6)}", f"right{min(len(r), 6)}"]
        last = l.rpartition("-")[2]  # a part of a compound of which only the last piece is broken
        joined, compound = (max(self.count(l + r), self.count(last + r)), max(self.count(l + "-" + r), self.count(last + "-" + r) if last != l else 0)) if counted else (0, 0)
        evidence = "none" if not joined and not compound else "joined" if joined >= compound else "compound"
        if evidence == "none" and counted and self.correct(l + r):
            evidence = "corrected"
        fl, fr = self.frequent(last), self.frequent(r)
        both = _grade(self.count(last) * self.count(r) / max(self.documents, 1) ** 2) // 4 if fl and fr and len(last) > 3 and len(r) > 3 else "no"
        out += ["is" + evidence, f"words{fl}{fr}{evidence}", f"both{both}{evidence}", f"long{len(last) > 3}{len(r) > 3}{fl}{fr}{evidence}", f"only{fl}{fr}{len(last) > 3}"]
        if len(last) <= 4:
            out += [f"first={last}", f"first={last}{evidence}"]
        return out

    def joins(self, left: str, right: str, sign: str) -> bool:
        """Whether the joiner takes a word that ends a line in a hyphen to go on in the next line's first word."""
        return self.joiner.score(self.join_features(left, right, sign)) > 0


def parse(text: str, model: Model) -> dict:
    """Lines, kinds of noise, joins and corrections of one text."""
    lines = text.split("\n")
    kinds = known_kinds(lines, model.stamps)
    heads = running(lines, kinds, model.lines)
    pages = {k for k, kind in enumerate(kinds) if kind == "page_no" and k not in heads}
    furniture = heads | pages
    found: set[tuple[int, str]] = {(k, "running") for k in heads} | {(k, "page_no") for k in pages}
    joins: dict[int, int] = {}
    compounds: dict[int, int] = {}
    fixes: dict[int, dict[str, str]] = defaultdict(dict)
    body = [k for k, kind in enumerate(kinds) if k not in furniture and kind != "blank"]
    follows = dict(zip(body, body[1:]))
    skip: dict[int, set[str]] = defaultdict(set)
    for k in body:
        raw = lines[k]
        tail = raw.rstrip("\r \t")[-1:]
        if tail not in ("-", "¬", "\xad") or raw.rstrip("\r \t")[-2:] == "--":
            continue
        s = _MARKS.sub("", _plain(raw))
        m = _HYPHEN.search(s)
        nxt = follows.get(k)
        if not m or nxt is None:
            continue
        head = re.match(r"[^\W\d_][\w'’-]*", _MARKS.sub("", _plain(lines[nxt])).lstrip())
        left = m[1]
        left = re.split(r"[\s(\"]", s[: m.end(1)])[-1]
        if not head or not left:
            continue
        a = re.sub(r"^[^\w]+", "", left)
        b = head[0]
        first_right = re.split(r"-", b)[0]
        if not a or not model.joins(a, first_right, tail):
            skip[k].add(left + tail)  # a compound at its own hyphen
            compounds[k] = nxt
            continue
        found.add((k, "broken_word"))
        joins[k] = nxt
        skip[k].add(left + tail)
        skip[nxt].add(b)
        whole = (a + b).lower()
        if not model.frequent(whole):
            true = model.misread(a + b)
            if true and len(true) > 2:
                same = 0
                while same < min(len(whole), len(true)) and whole[same] == true[same]:
                    same += 1
                if any(not c.isalpha() for c in a + b) and true == a + b:
                    same = next(i for i, c in enumerate(whole) if not c.isalpha())
                found.add((k if same < len(a) else nxt, "misread"))
                fixes[k]["\0joined"] = true
    misread, tokens, frequent, floor = model.misread, model.tokens, model.words, model.shield
    for k, kind in enumerate(kinds):
        if kind in ("blank", "page_no", "stamp") or (":" in lines[k][:12] and _HEADER.match(_plain(lines[k])) and "@" in lines[k]):
            continue
        own = skip.get(k)
        for pos, token in enumerate(lines[k].split()):
            if frequent.get(token, 0) >= floor:
                continue
            fixed = tokens[token] if token in tokens else misread(token)
            if fixed and own and any(token.startswith(x) for x in own):
                continue
            if fixed:
                found.add((k, "misread"))
                fixes[k][token] = fixed
    return {"lines": lines, "kinds": kinds, "furniture": furniture, "found": found, "joins": joins, "compounds": compounds, "fixes": fixes}


_LISTED = re.compile(r"^(?:\d{1,3}[.)]\s|[A-Z][\w-]*:\s)|.*\s{2,}[\d,.]+$|^[\d,.]+$")


def _fixed(s: str, fixes: dict[str, str]) -> str:
    """A line with its misread words corrected, in the case in which they stand."""
    for token, new in fixes.items():
        if token != "\0joined":
            core = token.strip(_EDGE).strip("-¬\xad").strip(_EDGE)
            new = new.upper() if core.isupper() else new.capitalize() if core[:1].isupper() else new
            s = s.replace(token, token.replace(core, new, 1), 1)
    return s


def repair(text: str, model: Model) -> str:
    """Continuous paragraphs: furniture gone, broken words joined, misread words corrected.

    A line end stays where the next word would have fitted on the line, as in titles and verse, and in lists, tables, headers and quotes.
    A paragraph that a page's end cut in two is one again.
    """
    p = parse(text, model)
    glued = {*p["joins"], *p["compounds"]}
    rows = []  # (line, glued to the next, quote mark before it, whether furniture stood before it)
    gap = cut_off = False
    for k, raw in enumerate(p["lines"]):
        if k in p["furniture"]:
            cut_off = True
            continue
        s = _stripped(raw)
        if not s:
            gap = True
            continue
        s = _fixed(s, p["fixes"].get(k, {}))
        whole = p["fixes"].get(k, {}).get("\0joined")
        rows.append([s, k in glued, k in p["joins"], gap, cut_off, whole])
        gap = cut_off = False
    lengths = sorted(len(r[0]) for r, n in zip(rows, rows[1:]) if not n[3] and len(r[0]) <= 110)
    width = lengths[int(0.9 * (len(lengths) - 1))] if lengths else 0
    # A paragraph of some lines shows its own width.
    own, begin = {}, 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i][3]:
            most = max((len(r[0]) for r in rows[begin : i - 1]), default=0)
            own |= dict.fromkeys(range(begin, i), most if i - begin > 3 and 0.75 * width <= most < width else width)
            begin = i
    out: list[str] = []
    for i, (s, glue, joined, _, _, whole) in enumerate(rows):
        before = rows[i - 1] if i else None
        if before is None:
            out.append(s)
        elif before[1]:
            t = _MARKS.sub("", s) if out[-1].lstrip()[:1] == ">" or s[:1] == ">" else s
            stem = re.sub(r"[-¬\xad]\s*$", "", out[-1]) if before[2] else out[-1].rstrip()
            if before[5]:  # the whole word was misread
                head = re.match(r"[^\W\d_][\w'’]*", t)
                tail = re.search(r"[^\W\d_][\w'’]*$", stem)
                if head and tail:
                    stem, t = stem[: tail.start()], (before[5].capitalize() if tail[0][:1].isupper() else before[5]) + t[head.end() :]
            out[-1] = stem + t
        else:
            goes_on = before[0][-1:] not in ".?!:;" and s[:1].islower()
            if rows[i][3] and not (rows[i][4] and goes_on):
                out += ["", s]
            elif s[:1] == ">" or before[0][:1] == ">" or _LISTED.match(s) or _LISTED.match(before[0]) or len(before[0]) > 110:
                out.append(s)
            elif rows[i][4] and goes_on or len(before[0]) + 1 + len(s.split(" ", 1)[0]) > 0.95 * own[i]:
                out[-1] = f"{out[-1]} {s}"
            else:
                out.append(s)
    return "\n".join(out)


# ---------------------------------------------------------------- counts and training


def word_counts(df: DataFrame, text: str = "full_text") -> DataFrame:
    """word, n: in how many documents each mid-line word occurs as written, and, behind a #, each stamp; counted per task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.llm.scans as here

        c: Counter = Counter()
        for b in batches:
            for t in b[text]:
                if t:
                    c.update(set(here.WORD.findall(here._BROKEN.sub("\0 ", t))))
                    c.update("#" + x for x in here.rising_stamps(t))
            if len(c) > 300_000:
                yield pd.DataFrame({"word": list(c), "n": list(c.values())})
                c = Counter()
        if c:
            yield pd.DataFrame({"word": list(c), "n": list(c.values())})

    made = spread(df.select(text)).mapInPandas(run, "word string, n long")
    return made.groupBy("word").agg(F.sum("n").alias("n"))


def _confusable(words: dict[str, int], documents: int) -> list[tuple[str, str]]:
    """(rare form, frequent word) at one edit of up to two letters on either side, by way of shared masked forms."""
    frequent = {w for w, n in words.items() if n >= documents * 0.004 and 4 <= len(w) <= 16}
    rare = [(w, n) for w, n in words.items() if n < max(3, documents * 0.002) and 4 <= len(w) <= 18]
    masks: dict[str, list[str]] = defaultdict(list)

    def masked(w: str) -> set[str]:
        return {w[:k] + "_" + w[k + size :] for size in (1, 2) for k in range(len(w) - size + 1)}

    for w in frequent:
        for m in masked(w):
            masks[m].append(w)
    pairs = []
    for w, _ in sorted(rare, key=lambda x: (-x[1], x[0])):
        if w in frequent:
            continue
        near = {v for m in masked(w) for v in masks.get(m, ())}
        if near:
            v = min(near, key=lambda x: (-words[x], x))
            if words[v] >= RATIO * words[w]:
                pairs.append((w, v))
    return pairs


_SIGNED = re.compile(r"[^\W\d_]*[¢†|0-9][^\W\d_]+|[^\W\d_]+[¢†|0-9]")


def _sample(df: DataFrame, key: str, text: str, most: int, documents: int) -> list[str]:
    """Texts of the documents with the least hashes of their ids, as a sample of a fixed number of rows.

    A first cut by hash leaves about twice that number, so that no task sends the driver more than its share.
    """
    h = F.xxhash64(key)
    cut_at = min(1 << 20, int((1 << 20) * 2 * most / max(documents, 1)) + 1)
    rows = df.filter((F.char_length(text) <= SAMPLE_CHARS) & (F.pmod(h, F.lit(1 << 20)) < cut_at)).select(text, F.pmod(h, F.lit(1 << 20)).alias("_p"), h.alias("_h"))
    return [r[0] for r in rows.orderBy("_p", "_h").limit(most).select(text).collect()]


def train(df: DataFrame, key: str = "doc_id", text: str = "full_text") -> Model:
    """Count all documents' words and train both perceptrons on a bounded sample; the same documents give the same model."""
    documents = df.count()
    counts = word_counts(df, text)
    kept = counts.filter(F.col("n") >= SHARE * documents / 4)
    rows = kept.limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError("the word list exceeds its bound")
    counted = {r["word"]: r["n"] for r in rows}
    return fit(counted, documents, _sample(df, key, text, SAMPLE, documents))


def fit(counted: dict[str, int], documents: int, sample: list[str]) -> Model:
    """The model of counted words and stamps and a sample of texts."""
    words: dict[str, int] = defaultdict(int)
    small: Counter = Counter()
    stamps = frozenset(w[1:] for w, n in counted.items() if w[0] == "#" and n >= max(2, SHARE * documents))
    for w, n in counted.items():
        if w[0] != "#":
            words[w.lower()] += n
            if w[0].islower():
                small[w.lower()] += n
    words = dict(words)
    # Forms with signs are no words for the counts; they come from the sample.
    signed = Counter(t.strip(_EDGE).lower() for x in sample for t in x.split() if _SIGNED.fullmatch(t.strip(_EDGE)))
    known = words | {w: min(n, 1) for w, n in signed.items() if w not in words}
    # Typing errors in names must not pass for misreading: names stand almost never in small letters.
    pairs = [(w, v) for w, v in _confusable(known, max(documents, 1)) if small[v] > 0.2 * words[v]][:PAIRS]
    uses, inner = Counter(), Counter()
    for seen, true in pairs:
        ops = operations(seen, true)
        edits = _edits(seen, ops)
        if len(edits) == 1:
            a, b = edits[0]
            uses[a, b] += 1
            inner[a, b] += ops[0] == "keep" and ops[-1] == "keep" and small[true] > 0.8 * words[true]
    # An operation counts if different words show it, more often than typing errors would. Insertions and deletions must show within words:
    # at their ends they come from pieces of words. What is confused in one direction needs less to be believed in the other, if it is a group of letters.
    enough = max(3, sum(uses.values()) // 450)
    confusions: dict[str, list[str]] = defaultdict(list)
    trusted = set()
    for (a, b), n in sorted(uses.items()):
        if not a or unicodedata.normalize("NFKC", a) != a or not (n >= enough or len(a) + len(b) > 2 and uses[b, a] >= enough and n >= 2):
            continue
        confusions[a].append(b)
        if b and a not in b and b not in a or inner[a, b] >= enough:
            trusted.add((a, b))
    model = Model(words, documents, Ranker(), dict(confusions), stamps=stamps)
    model.editor.train(_editor_examples(model, known, trusted), rounds=6)
    model.known.clear()
    model.tokens.clear()
    model.joiner.train(_joiner_examples(model, sample), rounds=6)
    model.lines = train_lines(sample, stamps)
    return model


def _editor_examples(model: Model, known: dict[str, int], trusted: set[tuple[str, str]]) -> list[tuple[list[list[str]], int]]:
    """Words with what becomes of them: a word that trusted operations turn into one ``RATIO`` times as frequent is a misread form, others are kept."""
    out, left = [], {True: PAIRS, False: 3 * PAIRS}
    for word in sorted(known, key=lambda w: (-known[w], w)):
        made = sorted(model.edits(word)) if len(word) > 1 else []
        if not made:
            continue
        own, best = model.own(word), None
        if own < min(model.shield, model.documents / RATIO):
            good = [(-len(done), model.count(m), m, k) for k, (m, done) in enumerate(made, 1) if model.count(m) >= max(2, RATIO * own) and all((a, b) in trusted for _, a, b in done)]
            best = max(good) if good else None
        if left[best is not None] <= 0:
            continue
        left[best is not None] -= 1
        keep = model.keep_features(word)
        out.append(([keep, *(model.candidate_features(word, m, done) for m, done in made)], best[3] if best else 0))
        if best and any(c in model.signs for c in word):
            # The same form as if no list had the word that it makes.
            k, a, b = made[best[3] - 1][1][0]
            alone = model.candidate_features(word, "", [(k, a, b)])
            out.append(([keep, alone], 1))
            out.append(([keep, [f for f in alone if f[0] not in "lrbwx" or f == "replace"]], 1))
    return out


def _joiner_examples(model: Model, sample: list[str]) -> list[tuple[list[list[str]], int]]:
    """Line ends of the sample that the counts settle, compounds of the list, and words of the list cut in two; each also as if it were not counted."""
    out = []

    def add(l: str, r: str, sign: str, join: bool, counted: bool = True) -> None:
        out.append(([[], model.join_features(l, r, sign, counted)], int(join)))

    for t in sample:
        for m in re.finditer(r"([^\W\d_][\w'’]*)([-¬\xad])[ \t]*\r?\n[> \t]*([^\W\d_][\w'’]*)", t):
            l, r = m[1].lower(), m[3].lower()
            joined, compound = model.count(l + r), model.count(l + "-" + r)
            if m[2] != "-" or joined or compound:
                add(l, r, m[2], m[2] != "-" or joined >= compound)
                if m[2] != "-" or joined > 4 * compound or compound > 4 * joined:
                    add(l, r, m[2], m[2] != "-" or joined >= compound, False)
    for w in sorted(model.words, key=lambda w: (-model.words[w], w))[:PAIRS]:
        if "-" in w:
            l, _, r = w.rpartition("-")
            if l and r and model.count(l + r) < model.count(w):
                add(l, r, "-", False)
                add(l, r, "-", False, False)
        elif len(w) >= 6 and w.isalpha():
            for k in {2 + hash_of(w) % (len(w) - 3), len(w) // 2}:
                add(w[:k], w[k:], "-", True)
                add(w[:k], w[k:], "-", True, False)
    return out


def _edits(seen: str, ops: list[str]) -> list[tuple[str, str]]:
    """The changed stretches of a word as (what stood there, what belongs there)."""
    out, k = [], 0
    while k < len(seen):
        if ops[k] == "keep":
            k += 1
            continue
        a, b = seen[k], "" if ops[k] == "delete" else ops[k][1:]
        k += 1
        while k < len(seen) and ops[k] == "delete":
            a += seen[k]
            k += 1
        out.append((a, b))
    return out


def train_lines(texts: list[str], stamps: frozenset[str] = frozenset()) -> Perceptron | None:
    """Examples: sure candidates are running lines, also as if their title were not known; candidates that begin or end within a sentence, and lines elsewhere, as if they stood at a page's end, are text."""
    examples = []
    for t in texts:
        lines = t.split("\n")
        kinds = known_kinds(lines, stamps)
        found = candidates_of(lines, kinds)
        for k, kind in enumerate(kinds):
            if kind != "text":
                continue
            if k in found and found[k].sure(k):
                c = found[k]
                examples.append((line_features(lines, k, kinds) + c.features(k), "running"))
                if c.tight and k > 3 and not c.numbered:
                    examples.append((line_features(lines, k, kinds) + replace(c, title=False, again=False).features(k), "running"))
            elif k in found and (found[k].text[0].islower() or found[k].text[-1] in ",;:?!") and not found[k].again:
                examples.append((line_features(lines, k, kinds) + found[k].features(k), "text"))
            elif k > 5 and hash_of(lines[k]) % 3 == 0 and not any(0 <= j < len(kinds) and kinds[j] in ("page_no", "stamp") for j in range(k - 2, k + 3)):
                moved = list(kinds)
                moved[k - 1] = ("stamp", "page_no")[hash_of(lines[k]) // 3 % 2]
                s = _stripped(lines[k])
                letters = [c for c in s if c.isalpha()]
                caps = sum(c.isupper() for c in letters) > 0.85 * max(len(letters), 1) and len(s.split()) >= 3
                examples.append((line_features(lines, k, moved) + Candidate(s, False, True, False, False, caps).features(k), "text"))
    return Perceptron().train(examples, rounds=4) if any(y == "running" for _, y in examples) else None


def hash_of(s: str) -> int:
    import zlib

    return zlib.crc32(s.encode("utf-8", "replace"))


def _with_model(df: DataFrame, key: str, text: str, model: Model, schema: str, row):
    shared = df.sparkSession.sparkContext.broadcast((model.words, model.documents, model.editor.weights, model.confusions, model.joiner.weights, model.lines and (model.lines.weights, model.lines.labels), model.stamps))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.llm.scans as here

        words, documents, weights, confusions, joiner, lines, stamps = shared.value
        m = here.Model(words, documents, here.Ranker(weights), confusions, here.Ranker(joiner), here.Perceptron(*lines) if lines else None, stamps)
        for b in batches:
            made = row(b, m)
            if len(made):
                yield made

    return spread(df.select(key, text).filter(F.col(key).isNotNull())).mapInPandas(run, schema)


def found(df: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """p1_found: doc_id, line_no (from 1), kind of every line with noise; null and empty texts have none."""
    model = model or train(df, key, text)

    def row(b: pd.DataFrame, m: Model) -> pd.DataFrame:
        import folioscope.llm.scans as here

        ids, nos, kinds = [], [], []
        for d, t in zip(b[key], b[text], strict=True):
            if t:
                for k, kind in sorted(here.parse(t, m)["found"]):
                    ids.append(d)
                    nos.append(k + 1)
                    kinds.append(kind)
        return pd.DataFrame({key: ids, "line_no": nos, "kind": kinds})

    return _with_model(df, key, text, model, f"{key} long, line_no long, kind string", row)


def repaired(df: DataFrame, model: Model | None = None, key: str = "doc_id", text: str = "full_text") -> DataFrame:
    """doc_id, repaired: every text as continuous paragraphs; a null text stays null, an empty one empty."""
    model = model or train(df, key, text)

    def row(b: pd.DataFrame, m: Model) -> pd.DataFrame:
        import folioscope.llm.scans as here

        return pd.DataFrame({key: b[key], "repaired": [here.repair(t, m) if t else t for t in b[text]]})

    return _with_model(df, key, text, model, f"{key} long, repaired string", row)
