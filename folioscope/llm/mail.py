"""Quoted history and signatures in e-mails (problem 4).

For each mail a pattern automaton (Aho-Corasick) holds the sentences of all earlier messages of its thread, which are the messages quoted in it and
the mail that it answers (``in_reply_to``), with the closing lines that its sender uses in other mails too; one more, the same for all, holds the
device lines, notices and closings that many senders use. The lines that are left by structure are scanned with both, matched
intervals are merged, and lines that they cover are subtracted. Structure takes out what no pattern can know: headers, attributions, quote
marks or indents, the forwarded tail behind a separator, sign-offs, signatures, running lines and page numbers. What is left was newly written.

A preview is the beginning of a quoted message as it stands in the mail; its lines are those at the depth of its first
line, up to its closing, less what the automata cover. A last line that is cut off within a known closing is none of its lines.

Nothing of the closings is listed beforehand but the usual words of farewell. They are counted over all mails: a sender's own lines, of which those in
at least ``CLOSING_SHARE`` of their mails are kept, and the last blocks of all mails, of which those are kept that at least ``COMMON_SHARE``
of all senders use and that stand almost nowhere else. Both shares bound their number; copies of a mail count once, as they have one sender. The
senders' lines meet the mails in a join on (sender, salt), as one sender may have a third of all mails; the common ones are broadcast after a check of their number.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.scans import _plain, known_kinds, rising_stamps, running
from folioscope.session import cut, spread

#: A closing line is known for a sender if it ends at least this share of their mails, and at least two.
CLOSING_SHARE = 0.05
#: A closing is common if at least this share of all senders use it, and three; and the most that may be broadcast.
COMMON_SHARE = 0.01
MOST_COMMON = 200_000
SALTS = 8
#: Known closings of more words than this are matched by their runs of so many words, so that one wrongly read word spares the rest.
RUN_WORDS = 3
#: A line is subtracted if merged matches cover this share of it.
COVERED = 0.7

# Words that open a header line, close a letter, end an attribution, begin a device line or a notice.
_HEADER = re.compile(r"^(?:from|sent|to|cc|bcc|date|subject|importance|reply-to|message-id|in-reply-to|re|fw|fwd|attachments?|von|gesendet|an|betreff|fra|sendt|til|emne|de|envoyé|à|objet|enviado|para|asunto)\s*:", re.I)
_SIGN_OFF = re.compile(
    r"^(?:best|best regards|best wishes|all best|all the best|regards|kind regards|warm regards|with kind regards|warmly|cheers|thanks|many thanks|thanks again|thank you|sincerely|sincerely yours|yours sincerely|yours truly|yours|"
    r"yours faithfully|respectfully|cordially|mit freundlichen grüßen|mit freundlichen gruessen|freundliche grüße|viele grüße|beste grüße|med vennlig hilsen|vennlig hilsen|hilsen|mvh|cordialement|bien cordialement|bien à vous|amitiés|"
    r"saludos|un saludo|saludos cordiales|atentamente)\s*[,.!]?$",
    re.I,
)
_DELIMITER = re.compile(r"^(?:--|—|_{3,}|-{2,}|\*(?: ?\*){2,}|={3,}|~{3,})$")
_FORWARD = re.compile(r"^(?:-{2,}\s*(?:original message|original melding|opprinnelig melding|ursprüngliche nachricht|message d'origine|message original|mensaje original|forwarded message|forwarded by.*|weitergeleitete nachricht|message transféré|videresendt melding)\s*-{2,}|begin forwarded message:?|_{20,})$", re.I)
_DEVICE = re.compile(r"^(?:sent from (?:my|a) |sent via |von meinem .* gesendet|sendt fra min |envoyé de(?:puis)? mon |enviado desde mi )", re.I)
_NOTICE = re.compile(r"^(?:confidentiality notice|disclaimer|this (?:e-?mail|message) (?:may contain|is confidential|and any|contains)|if you are not the intended)", re.I)
_SAID = re.compile(r"(?:\bwrote\s*:|\bwrote on\b.*:|\bschrieb\b.*:|\ba écrit\s*:|\bescribió\s*:|\bskrev\b.*:|\bhar skrevet\b.*:)\s*$")
_SAID_START = re.compile(r"^(?:on|am|le|el|den|på)\s", re.I)
_ROLE = re.compile(r"^(?:[A-Z][\w&/-]*)(?: (?:of|and|for|[A-Z][\w&/-]*)){0,3}$")
_PHONE = re.compile(r"^(?:(?:t|m|p|tel|phone|mobile|cell|fax|tlf)[.:]*\s*\+?[\d(][\d ().-]{5,}|\+[\d ().-]{6,}|\(?\d{3}[) .-]{0,2}\d{3,4}(?:[ .-]\d{4})?)$", re.I)
_NAMED = re.compile(r"^(?:[A-ZÅÄÖØÜÉÆÑ\"][\w.'’\"-]*,?)(?: (?:(?:of|and|for|the|de|von|van) )?[A-ZÅÄÖØÜÉÆÑ][\w.'’&/-]*,?){0,4}$")
_ADDRESS = re.compile(r"^<?[^\s@<>]+@[^\s@<>]+\.[a-z]+>?$", re.I)
_QUOTE = re.compile(r"^((?:[ \t]*>)+)")
_SPACE = re.compile(r"\s+")
_HYPHENS = re.compile("[-¬\xad]")
_REAL = {"from:", "von:", "fra:", "de:"}
_OTHER = {"sent:", "date:", "to:", "gesendet:", "sendt:", "an:", "til:", "à:", "para:", "enviado:", "envoyé:", "subject:"}


def depth_of(line: str) -> int:
    m = _QUOTE.match(line)
    return m[1].count(">") if m else 0


def unquoted(line: str) -> str:
    return _QUOTE.sub("", line, count=1).strip()


def display_name(address: str | None) -> str:
    if not address:
        return ""
    return re.sub(r"\s*<[^>]*>\s*", "", address).strip().strip("\"'").strip()


def _norm(s: str) -> str:
    return _SPACE.sub(" ", s).strip().lower()


def _bare(s: str) -> str:
    """The form in which patterns are matched: small letters, single blanks, no hyphens, as line ends may break a word."""
    return _SPACE.sub(" ", _HYPHENS.sub("", s)).strip().lower()


def attribution(lines: list[str], k: int) -> int:
    """How many lines from ``k`` on are an attribution (0 if none), on one or up to three lines of one depth."""
    depth, text = depth_of(lines[k]), ""
    for n in range(3):
        if k + n >= len(lines) or depth_of(lines[k + n]) != depth:
            return 0
        s = unquoted(_plain(lines[k + n]))
        if not s:
            return 0
        text = f"{text} {s}".strip()
        if _SAID.search(text):
            if re.search(r"\bwrote: ", text):
                return 0
            marked = "@" in text or re.search(r"\d", text) or _SAID_START.match(text) or len(text) < 90
            # A sentence that ends in 'wrote:' is quoted speech only if a date or an address stands in it.
            return n + 1 if marked and (n == 0 or _SAID_START.match(text) or "@" in text or re.search(r"\d{4}|\d:\d\d", text)) else 0
        if n == 0 and not (_SAID_START.match(s) or "@" in s or re.search(r"\d{1,2}:\d\d|\d{4}", s)):
            return 0
        if s.endswith(".") and not s.endswith((" p.m.", " a.m.")):
            return 0
    return 0


class Layout:
    """What one backward pass over the lines of a message tells of each: whether headers of a quoted message, or a block of names, begin there."""

    def __init__(self, lines: list[str]):
        n = len(lines)
        self.plain = [unquoted(_plain(x)) for x in lines]
        self.depth = [depth_of(x) for x in lines]
        self.header = [False] * (n + 1)
        # Names, roles and contacts up to the end of a block: how many lines, or -1 if others stand among them, and whether a contact is one.
        self.names, self.contact = [0] * (n + 1), [False] * (n + 1)
        real = other = False
        for k in range(n - 1, -1, -1):
            s = self.plain[k]
            m = _HEADER.match(s)
            name = m[0].lower() if m else ""
            real, other = bool(m) and (real or name in _REAL), bool(m) and (other or name in _OTHER)
            self.header[k] = real and other
            if not s or _DEVICE.match(s):
                continue
            ends = k + 1 >= n or not self.plain[k + 1] or self.depth[k + 1] != self.depth[k] or _DEVICE.match(self.plain[k + 1])
            more, contact = (0, False) if ends else (self.names[k + 1], self.contact[k + 1])
            is_contact = bool(_PHONE.match(s) or _ADDRESS.match(s))
            fits = is_contact or bool(_NAMED.match(s)) and len(s) <= 45 and s[-1] not in ",:-"
            self.names[k] = more + 1 if fits and more >= 0 else -1
            self.contact[k] = is_contact or contact

    def is_header(self, k: int) -> bool:
        return self.header[k] if k < len(self.header) else False


class Reader:
    """Walks the lines of one message and tells which its author newly wrote."""

    def __init__(self, author: str | None):
        name = display_name(author)
        self.names = {n for n in (_norm(name), _norm(name.rstrip(",")), *(_norm(p) for p in name.replace(",", " ").split() if len(p) > 1)) if n}
        self.full = _norm(name)
        m = re.search(r"([^\s<>@]+)@[^\s<>@]+", author or "")
        self.parts = {p for p in re.split(r"[._-]", m[1].lower()) if len(p) > 2} if m else set()

    def signs(self, s: str) -> bool:
        """Whether a line is the author's bare name, as it stands under a letter."""
        t = _norm(s).rstrip(",.")
        if bool(t) and t == self.full.rstrip(",."):
            return True
        if s.rstrip()[-1:] in ",:-":
            return False  # a greeting
        words = set(re.split(r"[\s,.-]+", t))
        return bool(self.parts) and self.parts <= words and len(words) <= 5 and bool(_NAMED.match(s))

    def block(self, at: Layout, k: int) -> bool:
        """Whether a block of two lines or more, all of them names, roles or contacts, begins at ``k``."""
        n = at.names[k]
        return n >= 3 or n == 2 and (at.contact[k] or self.signs(at.plain[k]))

    def contact(self, s: str) -> bool:
        return bool(_PHONE.match(s) or _ADDRESS.match(s))

    def new_lines(self, lines: list[str], base: int = 0, drop: set[int] = frozenset()) -> list[int]:
        """Places of the lines that stand at depth ``base`` and are neither quoted, header, attribution, closing nor furniture."""
        if drop:
            # Furniture may stand in the midst of headers, attributions and signatures: the rest is read without it.
            kept = [k for k in range(len(lines)) if k not in drop]
            return [kept[k] for k in self.new_lines([lines[k] for k in kept], base)]
        out: list[int] = []
        state, k, n = "body", 0, len(lines)
        quoted_indent, at = False, Layout(lines)
        while k < n:
            if k in drop:
                k += 1
                continue
            raw = lines[k]
            s = unquoted(_plain(raw))
            depth = depth_of(raw)
            if not s:
                if state == "notice":
                    state = "closed" if self.was_closed else "body"
                k += 1
                continue
            if depth != base:
                if depth < base:
                    return out  # the quoted message is over
                quoted_indent = False
                if state == "notice":
                    state = "body"
                k += 1
                continue
            if quoted_indent and raw[:4].strip() == "" and len(raw) - len(raw.lstrip()) >= 4:
                k += 1
                continue
            if _FORWARD.match(s) and not (_DELIMITER.match(s) and not at.is_header(self._next(lines, k + 1, drop))):
                return out
            if k > 0 and at.is_header(k):
                return out
            a = attribution(lines, k)
            if a:
                after = self._next(lines, k + a, drop)
                if after < n and depth_of(lines[after]) > base:
                    state = "body"
                    k += a
                    continue
                if after < n and re.match(r"^\s{4,}\S", _plain(lines[after])):
                    state, quoted_indent = "body", True
                    k += a
                    continue
                if "@" in " ".join(lines[k : k + a]) or after >= n or a > 1 or re.search(r"\d", s):
                    # What follows an attribution without any mark is the quoted message up to the end.
                    return out
            if _DEVICE.match(s):
                state = "closed" if state == "closed" else state
                k += 1
                continue
            if _NOTICE.match(s) and state != "notice":
                self.was_closed = state == "closed"
                state = "notice"
                k += 1
                continue
            if state == "notice":
                k += 1
                continue
            if state == "body" and (_SIGN_OFF.match(s) and self._closes(lines, k, base, drop) or _DELIMITER.match(s) and self._closes(lines, k, base, drop) or self.signs(s) and out_of_prose(lines, k, base, drop) or self.contact(s) or out_of_prose(lines, k, base, drop) and self.block(at, k)):
                state = "closed"
                k += 1
                continue
            if state == "closed":
                # Prose after a closing, as between two quoted blocks, is new again only behind a quoted block.
                k += 1
                continue
            out.append(k)
            k += 1
        return out

    was_closed = False

    @staticmethod
    def _next(lines: list[str], k: int, drop: set[int]) -> int:
        while k < len(lines) and (k in drop or not unquoted(_plain(lines[k]))):
            k += 1
        return k

    def _closes(self, lines: list[str], k: int, base: int, drop: set[int]) -> bool:
        """A sign-off or delimiter closes if short lines, or nothing, follow up to the next blank line or change of depth."""
        j = k + 1
        while j < len(lines):
            if j in drop:
                j += 1
                continue
            s = unquoted(_plain(lines[j]))
            if not s or depth_of(lines[j]) != base:
                return True
            if len(s) > 60 and "@" not in s or s.endswith((".", "?")) and len(s.split()) > 5:
                return False
            j += 1
        return True


def out_of_prose(lines: list[str], k: int, base: int, drop: set[int]) -> bool:
    """Whether a name stands at the beginning of a block: after a blank line, furniture, or a line that ends a sentence or is a sign-off."""
    j = k - 1
    while j >= 0 and j in drop:
        j -= 1
    if j < 0:
        return False
    s = unquoted(_plain(lines[j]))
    return not s or depth_of(lines[j]) != base or s[-1:] in ".?!," or bool(_SIGN_OFF.match(s))


def furniture(lines: list[str], stamps: frozenset[str] = frozenset()) -> set[int]:
    kinds = known_kinds(lines, stamps)
    return running(lines, kinds) | {k for k, kind in enumerate(kinds) if kind == "page_no"}


def header_end(lines: list[str]) -> int:
    """Where the headers at the top of a mail end: behind the first blank line after them, or 0 without any."""
    k, n = 0, len(lines)
    while k < n and not _plain(lines[k]).strip():
        k += 1
    if k >= n or not _HEADER.match(_plain(lines[k]).strip()):
        return 0
    while k < n and _plain(lines[k]).strip():
        k += 1
    return k


def mail_lines(text: str, author: str | None, stamps: frozenset[str] = frozenset()) -> list[int]:
    """Places of the lines of a mail that its sender newly wrote, by structure."""
    lines = text.split("\n")
    top = header_end(lines)
    drop = {k - top for k in furniture(lines, stamps) if k >= top}
    return [k + top for k in Reader(author).new_lines(lines[top:], drop=drop) if _plain(lines[k + top]).strip(" \t\xa0>")]


def preview_lines(text: str, author: str | None, common: Patterns | None = None, stamps: frozenset[str] = frozenset()) -> list[int]:
    """Places of the lines of a preview that the quoted message's author wrote."""
    lines = text.split("\n")
    if not lines:
        return []
    base = depth_of(lines[0])
    if base == 0:
        # An indented message lost the indent of its first line; lines without it are no longer the author's.
        later = [x for x in lines[1:] if x.strip()]
        indents = [len(x) - len(x.lstrip(" ")) for x in later]
        if indents and indents[0] >= 4:
            step = indents[0]
            for k in range(1, len(lines)):
                if lines[k].strip() and len(lines[k]) - len(lines[k].lstrip(" ")) < step:
                    # The cut may have fallen into the indent of the last line.
                    if k == len(lines) - 1 and not lines[k].strip():
                        continue
                    lines = lines[:k]
                    break
            lines = [x[step:] if x[:step].strip() == "" else x for x in lines]
    drop = {k for k in furniture(lines, stamps) if k}
    marks = [k for k, x in enumerate(lines) if x.strip()]
    if base and any(depth_of(lines[k]) < base and k not in drop for k in marks):
        # Lines of lower depth are answers in between; the author's lines go on behind them at the old depth.
        drop |= {k for k in marks if depth_of(lines[k]) < base and not (k == marks[-1] and not unquoted(lines[k]))}
    out = Reader(author).new_lines(lines, base=base, drop=drop)
    if out and len(text) >= 199 and out[-1] == len(lines) - 1 and len(lines) > 1 and not unquoted(_plain(lines[-2])):
        # The cut fell into the first line of a block: of a closing, separator, device line or notice?
        whole = unquoted(_plain(lines[-1]))
        last = _norm(whole)
        begun = re.match(r"(?:On|Am|Le|El|Den|På) (?:\w{2,4}\.?,? )?.{0,14}\d", whole) or re.search(r"<[^<>]*$", whole) or re.match(r"(?:From|Von|Fra|De): [A-ZÅÄÖØÜÉ]", whole)
        if begun or len(last) >= 3 and (common is not None and common.begins(_bare(whole)) or "begin forwarded message:".startswith(last)) or Reader(author).full.startswith(last) and len(last) >= 3 or re.fullmatch(r"[-_*—=]{2,}.{0,20}", last):
            out.pop()
    out = [k for k in out if _plain(lines[k]).strip(" \t\xa0>")]
    return common.subtract(lines, out) if common is not None else out


def sentences(text: str) -> list[str]:
    """Sentences of at least six words of a message, without headers, greetings, marks and line ends, as patterns."""
    lines = text.split("\n")
    out, block = [], []
    for x in [*lines[header_end(lines) :], ""]:
        s = unquoted(_plain(x))
        if s and not (not block and s[-1] in ",:-" and len(s.split()) <= 5):
            block.append(s)
        elif not s and block:
            out += [p for p in split_sentences(block) if len(p.split()) >= 6 and p[-1:] in ".!?"]
            block = []
    return out


def split_sentences(lines: list[str]) -> list[str]:
    """The sentences of a block in the form in which patterns are matched."""
    return [x for s in re.split(r"(?<=[.!?]) ", _SPACE.sub(" ", joined(lines)[0]).strip()) if (x := _bare(s))]


def joined(lines: list[str]) -> tuple[str, list[tuple[int, int]]]:
    """Lines as one text, without a blank behind a hyphen, and the span of each."""
    text, spans = "", []
    for x in lines:
        if text and not text.endswith(("-", "¬", "\xad")):
            text += " "
        spans.append((len(text), len(text) + len(x)))
        text += x
    return text, spans


class Patterns:
    """An Aho-Corasick automaton of whole sentences and of the word runs of closings; ``subtract`` takes out the lines that its matches cover."""

    def __init__(self, whole: Iterable[str] = (), closings: Iterable[str] = ()):
        import ahocorasick

        runs, self.closings = {p for p in whole if p}, sorted({c for c in closings if c})
        for c in self.closings:
            words = c.split()
            runs |= {c} if len(words) <= RUN_WORDS else {" ".join(words[k : k + RUN_WORDS]) for k in range(len(words) - RUN_WORDS + 1)}
        self.automaton = None
        if runs:
            self.automaton = ahocorasick.Automaton()
            for p in sorted(runs):
                self.automaton.add_word(f" {p} ", len(p) + 2)
            self.automaton.make_automaton()

    def begins(self, text: str) -> bool:
        """Whether a known closing begins with ``text``."""
        k = bisect.bisect_left(self.closings, text)
        return k < len(self.closings) and self.closings[k].startswith(text)

    def subtract(self, lines: list[str], new: list[int]) -> list[int]:
        """``new`` without lines that merged matches cover by at least ``COVERED``."""
        if self.automaton is None or not new:
            return new
        text, spans = " ", []
        for k in new:
            s = _SPACE.sub(" ", unquoted(_plain(lines[k]))).strip().lower()
            bare = _HYPHENS.sub("", s)
            spans.append((len(text), len(text) + len(bare)))
            text += bare if s[-1:] in "-¬\xad" else bare + " "
        text += " "
        merged: list[list[int]] = []
        for a, b in sorted((end - size + 1, end + 1) for end, size in self.automaton.iter(text)):
            if merged and a <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], b)
            else:
                merged.append([a, b])
        if not merged:
            return new
        out, at = [], 0
        for k, (a, b) in zip(new, spans, strict=True):
            while at < len(merged) and merged[at][1] <= a:
                at += 1
            covered, j = 0, at
            while j < len(merged) and merged[j][0] < b:
                covered += min(b, merged[j][1]) - max(a, merged[j][0])
                j += 1
            if covered < COVERED * max(b - a, 1):
                out.append(k)
        return out


def own_part(lines: list[str]) -> tuple[int, int]:
    """Where the sender's own part begins, behind the headers, and where it ends, before anything quoted."""
    top, at = header_end(lines), Layout(lines)
    for k in range(top, len(lines)):
        if at.depth[k] or k > top and at.is_header(k) or _FORWARD.match(at.plain[k]) and not _DELIMITER.match(at.plain[k]) or attribution(lines, k):
            return top, k
    return top, len(lines)


def closing_lines(text: str, author: str | None) -> list[str]:
    """The last lines of a mail's own part that structure takes for its closing."""
    lines = text.split("\n")
    top, end = own_part(lines)
    kept = set(mail_lines(text, author))
    out = []
    for k in range(top, end):
        s = _plain(lines[k]).strip()
        if s and k not in kept and len(s) < 80 and (_ADDRESS.match(s) or _PHONE.match(s) or _ROLE.match(s)) and len(s.split()) > 1:
            out.append(_bare(s))
    return out


def tail_parts(text: str) -> list[tuple[str, bool]]:
    """Sentences and short lines of a mail's own part, with whether they stand in one of its last three blocks and not in its first."""
    lines = text.split("\n")
    top, end = own_part(lines)
    blocks: list[list[str]] = [[]]
    for k in range(top, end):
        s = _plain(lines[k]).strip()
        if s:
            blocks[-1].append(s)
        elif blocks[-1]:
            blocks.append([])
    blocks = [b for b in blocks if b]
    out: dict[str, bool] = {}
    for k, b in enumerate(blocks):
        tail = k >= max(1, len(blocks) - 3)
        for x in {*split_sentences(b), *(_bare(s) for s in b if len(s) < 60)}:
            out[x] = out.get(x, True) and tail
    return list(out.items())


def mails(documents: DataFrame, email_metadata: DataFrame) -> DataFrame:
    """doc_id, full_text, sender of every document that email_metadata lists; repeated rows count once."""
    sender = email_metadata.filter(F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("from_addr").alias("sender"))
    # Spread at the scan: asking a joined plan for its partitions would run its shuffles.
    return spread(documents.select("doc_id", "full_text").filter(F.col("full_text").isNotNull())).join(sender, "doc_id")


def count_closings(mail: DataFrame) -> DataFrame:
    """sender, what, line, n: in one pass over the mails, of each sender the mails (``all``), closing lines (``own``), tail parts (``tail``, with
    their text), the same parts elsewhere (``body``, by hash alone), and stamps; combined in the task before the shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.llm.mail as here

        for b in batches:
            n: Counter = Counter()
            for t, s in zip(b["full_text"], b["sender"], strict=True):
                s = s or ""
                n[s, "all", "", 0] += 1
                n.update((s, "own", x, 0) for x in set(here.closing_lines(t, s)))
                n.update((s, "tail" if tail else "body", x if tail else "", xxhash.xxh3_64_intdigest(x) >> 1) for x, tail in here.tail_parts(t))
                n.update((s, "stamp", x, 0) for x in here.rising_stamps(t))
            if n:
                yield pd.DataFrame([(*k, v) for k, v in n.items()], columns=["sender", "what", "line", "h", "n"])

    made = mail.select("full_text", "sender").mapInPandas(run, "sender string, what string, line string, h long, n long")
    return made.groupBy("sender", "what", "line", "h").agg(F.sum("n").alias("n"))


def known_closings(counted: DataFrame) -> DataFrame:
    """sender, closings (array): lines that end at least ``CLOSING_SHARE`` of a sender's mails, and two."""
    total = counted.filter("what = 'all'").select("sender", F.col("n").alias("all"))
    kept = counted.filter("what = 'own' and n >= 2 and sender <> ''").join(total, "sender").filter(F.col("n") >= CLOSING_SHARE * F.col("all"))
    return kept.groupBy("sender").agg(F.collect_list("line").alias("closings"))


def common_closings(counted: DataFrame) -> tuple[list[str], frozenset[str]]:
    """(closings that many senders use, stamps), at most ``MOST_COMMON``: each is used by ``COMMON_SHARE`` of the senders, so mails' mean number of tail parts bounds them."""
    senders = counted.filter("what = 'all'").count()
    least = max(3, COMMON_SHARE * senders)
    by_part = counted.filter("what in ('tail', 'body')").groupBy("h").agg(
        F.max("line").alias("line"), F.count_distinct(F.when(F.col("what") == "tail", F.col("sender"))).alias("senders"), F.sum(F.when(F.col("what") == "tail", F.col("n")).otherwise(0)).alias("tail"), F.sum("n").alias("n")
    )
    # A name under which somebody sends from several addresses is no common closing.
    names = counted.filter("what = 'all'").select(F.trim(F.lower(F.regexp_replace("sender", "<[^>]*>|[-¬\xad\"]", ""))).alias("line")).distinct()
    kept = by_part.filter((F.col("senders") >= least) & (F.col("tail") >= 0.9 * F.col("n")) & (F.length("line") > 2)).join(names, "line", "left_anti").select(F.lit("closing").alias("what"), "line")
    stamps = counted.filter("what = 'stamp'").groupBy("line").agg(F.sum("n").alias("n")).filter("n >= 2").join(F.broadcast(counted.filter("what = 'all'").agg(F.sum("n").alias("_all")))).filter(F.col("n") >= 0.01 * F.col("_all"))  # one row
    rows = kept.unionByName(stamps.select(F.lit("stamp").alias("what"), "line")).limit(MOST_COMMON + 1).collect()
    if len(rows) > MOST_COMMON:
        raise ValueError("the common closings exceed their bound")
    return [r.line for r in rows if r.what == "closing"], frozenset(r.line for r in rows if r.what == "stamp")


def answered(mail: DataFrame, email_metadata: DataFrame) -> DataFrame:
    """doc_id, answered: the text of the mail that each mail answers, where the archive holds it."""
    m = email_metadata.filter("doc_id is not null")
    to = m.filter("in_reply_to is not null and in_reply_to <> ''").groupBy("doc_id").agg(F.max("in_reply_to").alias("message_id"))
    of = m.filter("message_id is not null and message_id <> ''").groupBy("message_id").agg(F.min("doc_id").alias("_p"))
    links = to.join(of, "message_id").filter("_p <> doc_id").select("doc_id", "_p", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("_s"))
    # Only answered mails are sent on, once a salt, as one may have a third of all answers.
    texts = mail.select(F.col("doc_id").alias("_p"), F.col("full_text").alias("answered")).join(links.select("_p").distinct(), "_p", "left_semi")
    return links.join(texts.withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["_p", "_s"]).select("doc_id", "answered")


def found(documents: DataFrame, email_metadata: DataFrame, thread_messages: DataFrame) -> DataFrame:
    """p4_found: field, doc_id, message_index, line_no of every newly written line.

    Null and empty texts have no lines; a mail without sender has only names unknown. Repeated rows count once.
    """
    mail = cut(mails(documents, email_metadata))
    previews = thread_messages.filter("content_preview is not null and doc_id is not null").select("doc_id", F.col("message_index").cast("long").alias("message_index"), "author", "content_preview").distinct()
    per_thread = previews.groupBy("doc_id").agg(F.collect_list(F.struct("message_index", "author", "content_preview")).alias("earlier"))
    counted = cut(count_closings(mail))
    common, stamps = common_closings(counted)
    shared = documents.sparkSession.sparkContext.broadcast((common, stamps))
    closings = known_closings(counted).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = mail.withColumn("_s", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int"))
    rows = salted.join(closings, ["sender", "_s"], "left").join(per_thread, "doc_id", "left").join(answered(mail, email_metadata), "doc_id", "left").select("doc_id", "full_text", "sender", "closings", "earlier", "answered")

    def earlier_sentences(earlier, index: int, common, stamps) -> list[str]:
        """Sentences that the authors of the quoted messages behind ``index`` wrote."""
        import folioscope.llm.mail as here

        out = []
        for e in earlier if earlier is not None else ():
            if e["message_index"] is None or e["message_index"] > index:
                parts = e["content_preview"].split("\n")
                own = here.preview_lines(e["content_preview"], e["author"], common, stamps)
                out += here.sentences("\n".join(parts[k] for k in own if k < len(parts)))
        return out

    def of_mails(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.llm.mail as here

        lines_, stamps = shared.value
        common = here.Patterns((), lines_)
        for b in batches:
            ids, nos = [], []
            for d, t, who, closing, earlier, parent in zip(b["doc_id"], b["full_text"], b["sender"], b["closings"], b["earlier"], b["answered"], strict=True):
                if not t:
                    continue
                lines = t.split("\n")
                new = common.subtract(lines, here.mail_lines(t, who, stamps))
                whole = earlier_sentences(earlier, -1, common, stamps) + (here.sentences(parent) if parent else [])
                new = here.Patterns([*whole, *(closing if closing is not None else ())]).subtract(lines, new)
                ids += [d] * len(new)
                nos += [k + 1 for k in new]
            if ids:
                yield pd.DataFrame({"field": ["full_text"] * len(ids), "doc_id": ids, "message_index": [-1] * len(ids), "line_no": nos})

    def of_previews(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import folioscope.llm.mail as here

        lines_, stamps = shared.value
        common = here.Patterns((), lines_)
        for b in batches:
            out = []
            for d, i, who, t, earlier in zip(b["doc_id"], b["message_index"], b["author"], b["content_preview"], b["earlier"], strict=True):
                new = here.preview_lines(t, who, common, stamps)
                new = here.Patterns(earlier_sentences(earlier, i, common, stamps)).subtract(t.split("\n"), new)
                out += [(d, i, k + 1) for k in new]
            if out:
                yield pd.DataFrame({"field": ["content_preview"] * len(out), "doc_id": [r[0] for r in out], "message_index": [r[1] for r in out], "line_no": [r[2] for r in out]})

    schema = "field string, doc_id long, message_index long, line_no long"
    with_earlier = previews.join(per_thread, "doc_id")
    return rows.mapInPandas(of_mails, schema).unionByName(with_earlier.mapInPandas(of_previews, schema)).distinct()


def new_text(documents: DataFrame, email_metadata: DataFrame, thread_messages: DataFrame) -> DataFrame:
    """doc_id, new_text: of every mail only the lines that its sender newly wrote; empty where there is none."""
    lines = found(documents, email_metadata, thread_messages).filter("field = 'full_text'").groupBy("doc_id").agg(F.sort_array(F.collect_list("line_no")).alias("_n"))
    rows = mails(documents, email_metadata).join(lines, "doc_id", "left")
    parts = F.split("full_text", "\n")
    text = F.array_join(F.transform("_n", lambda n: F.regexp_replace(F.element_at(parts, n.cast("int")), "[\r\f\ufeff]", "")), "\n")
    return rows.select("doc_id", F.coalesce(text, F.lit("")).alias("new_text"))
