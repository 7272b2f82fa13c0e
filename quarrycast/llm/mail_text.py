"""Newly written lines of mails: without quoted messages, signatures, device lines and notices.

A grammar of lines finds what marks itself: prefixed quotes, header blocks, introductions, device lines and notices.
What is left of all messages of a thread, and the sentences of their marked quotes, become the patterns of one
automaton (Aho-Corasick over words) that knows when each was first written: sentences, and the lines of each
sender's closing blocks. Every message is scanned against it where it carries no mark; matches of what was written
before are merged to intervals. Intervals of at least LEAST words are quotes wherever they stand, any is one below
an introduction, and closing lines are below a closing formula.

Threads are groups of one shuffle of the bodies. The patterns of a thread of more than LARGE messages are collected
by an aggregation and spread over blocks, each with an automaton of its own; intervals of all blocks are united
before anything is derived from them, so results don't depend on how a thread is cut.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrycast.runtime import ship, small_enough

LARGE = 2_000  #: messages of a thread above which its patterns are spread over blocks
BLOCK = 20_000  #: patterns of one automaton of such a thread, and messages that one task scans against it
LEAST = 32  #: words of repeated sentences in a row that count as a quote without any mark
PATTERN = 64  #: words of the longest pattern
HINTED = 100_000  #: large threads whose names may be broadcast
LINES_KEPT = 100_000  #: lines whose features a worker remembers

# --- fixed values: wordings of mail programs and of closings ------------------------------------------------
CLOSINGS = """best|all the best|best regards|best wishes|kind regards|warm regards|warmly|regards|many thanks|thanks|thank you|thanks again|thanks and regards|with thanks|cheers|br|sincerely|sincerely yours|yours sincerely|yours faithfully|yours truly|respectfully|take care|talk soon
cordialement|bien cordialement|bien à vous|bien à toi|salutations|amicalement|merci|merci d'avance|meilleures salutations|sincères salutations
beste grüße|viele grüße|liebe grüße|mit freundlichen grüßen|freundliche grüße|herzliche grüße|gruß|grüße|mfg|vg|lg|danke|vielen dank
un cordial saludo|un saludo|saludos|saludos cordiales|cordiales saludos|atentamente|muchas gracias|gracias
atenciosamente|cordialmente|abraços|um abraço|obrigado|obrigada|cumprimentos|pozdrawiam|z poważaniem|с уважением|met vriendelijke groet|cordiali saluti|distinti saluti"""
DEVICE = r"""(?:sent|gesendet|envoyé|enviado|inviato|wysłane)\s+(?:from|von|mit|via|de|depuis|desde|da|z)\s+(?:my|meinem|meiner|mon|ma|mi|meu|minha|il mio|mojego|outlook|yahoo|mail\b|gmail|proton).*
von meinem .* gesendet.*
diese nachricht wurde von meinem .* gesendet.*
get (?:the )?(?:mail|outlook|e-?mail) .*(?:app|for|ios|android).*
download the .* app.*"""
NOTICES = r"""confidentiality notice|disclaimer\b[:.]?$|privileged\b.*\b(?:information|confidential)|information may be privileged|accepts? no liability|any copying or disclosure|\bthis (?:e-?mail|message|communication)(?: and (?:its|any) (?:attachments?|files))?[^.]{0,40}\b(?:is|are|may be|contains?)\b[^.]{0,40}\b(?:confidential|privileged|intended)|if you (?:received|have received|are not the) .{0,40}(?:mistake|error|recipient)|views expressed .{0,30}(?:author|sender)|no contract is formed|consider the (?:trees|environment)|before printing this|you (?:are receiving|receive|received) this (?:e-?mail|message)|^\W*unsubscribe\b|^\W*(?:this is an )?automated (?:message|notification|reply)|do not reply to this|registered (?:under no|office|in england)|all rights reserved
diese e-?mail ist vertraulich|sollten sie nicht der empfänger|vertrauliche informationen|bitte denken sie an die umwelt|handelsregister|newsletter abbestellen
ce (?:courriel|message|e-?mail) (?:est|et|peut)\b.*(?:confidentiel|pièces|destin)|destiné uniquement à|si vous n'êtes pas le destinataire|se désabonner|pensez à l'environnement
este (?:correo|mensaje|e-?mail)\b.*confidencial|si no es (?:usted )?el destinatario|darse de baja|antes de imprimir
esta mensagem\b.*confidencial|se você não é o destinatário|cancelar inscrição|ta wiadomość\b.*poufn|это письмо\b.*конфиденциальн"""
HEADER_WORDS = "from|to|cc|bcc|sent|date|subject|reply-to|von|an|gesendet|datum|betreff|de|à|a|cc|envoyé|date|objet|para|enviado(?: el)?|fecha|asunto|data|assunto|od|do|wysłano|temat|от|кому|дата|тема"
FIRST_HEADERS = "from|von|de|od|от"
FORWARDS = r"""-{2,}\s*(?:original message|forwarded message|forwarded by .*|ursprüngliche nachricht|weitergeleitete nachricht|message d['’]origine|message original|message transféré|mensaje original|mensaje reenviado|mensagem original|mensagem encaminhada|wiadomość oryginalna)\s*-{2,}
begin forwarded message:?
anfang der weitergeleiteten nachricht:?
début du message (?:transféré|réexpédié)\s*:?
inicio del mensaje reenviado:?"""
#: How a quote is introduced, as a whole, lines joined by a space.
INTROS = r"""on\b.{4,160}\d.{0,160}\bwrote\s*:
am\b.{4,160}\d.{0,160}\bschrieb\b.{0,120}:
le\b.{4,160}\d.{0,160}\ba écrit\s*:
el\b.{4,160}\d.{0,160}\bescribió\s*:
em\b.{4,160}\d.{0,160}\bescreveu\s*:
w dniu\b.{4,160}\d.{0,160}\bnapisał.{0,10}:
.{1,120}<\S+@\S+>\s*(?:wrote|writes|schrieb|schreibt|a écrit|écrit|escribió|escribe|escreveu)\s*:
\d{4}-\d\d-\d\d\s+\d\d:\d\d\b.{0,160}:
\*\s.{1,120}\[\d{4}-\d\d-\d\d.{0,20}\]\s*:
\*?.{1,80}\bwrote on\b.{4,80}:"""
# -------------------------------------------------------------------------------------------------------------

_lines = lambda s: "|".join(f"(?:{x})" for x in s.split("\n") if x)
_QUOTE = re.compile(r"^\s{0,3}(?:[>|»]|\w{1,4}>)")
_CLOSING = re.compile(rf"^\W*(?:{CLOSINGS.replace(chr(10), '|')})\s*[,.!–—-]*\s*$", re.I)
_DEVICE = re.compile(rf"^\W*(?:{_lines(DEVICE)})$", re.I)
_NOTICE = re.compile(_lines(NOTICES), re.I)
_RULE = re.compile(r"^\s*(?:-{2,}|—+|–+|_{2,}|={3,}|\*{3,}|~{3,}|#{3,})\s*$")
_SIGN = re.compile(r"^\s*(?:--|—|–|__)\s*$")
_HEADER = re.compile(rf"^\s*\*?(?:{HEADER_WORDS})\s*:\*?(?:\s|$)", re.I)
_FIRST_HEADER = re.compile(rf"^\s*\*?(?:{FIRST_HEADERS})\s*:\*?\s+\S.*", re.I)
_FORWARD = re.compile(rf"^\s*(?:{_lines(FORWARDS)})\s*$", re.I)
_INTRO = re.compile(rf"^\s*(?:{_lines(INTROS)})\s*$", re.I)
_CONTACT = re.compile(
    r"^\s*(?:(?:t|tel|phone|mobile|mob|m|cell|fax|direct|office|w|web|e|email|e-mail|skype|linkedin|twitter)\s*[.:]?\s*[+(\d/@h]\S.*|\+?[\d(][\d\s().-]{6,}|(?:https?://)?(?:www\.)?[\w-]+(?:\.[\w-]+)+(?:/\S*)?|<?\S+@\S+\.\S+>?|(?:she/her|he/him|they/them|she/they|he/they|sie/ihr|er/ihm)|working (?:days|hours)\s*:.*|\d+\w?\s+[^.!?]{2,40},\s*[^.!?]{2,40}|[^.!?]{2,50}\s[|·•]\s[^.!?]{2,50}|(?:recruiter|head|vp|director|manager|talent|people|engineer|founder|ceo|cto|hr|senior|lead|chief|president|partner|coordinator|specialist)\b[^.!?]{0,60})\s*$",
    re.I,
)
_POSTSCRIPT = re.compile(r"^\W*(?:p\.?\s*p?\.?\s*s\.?|n\.?b\.?|ps)\s*[:.)-]", re.I)
_WORD = re.compile(r"[^\W_]+")
_STOP = re.compile(r"(?<=[.!?。！？।])\s+|\n\s*\n")
#: Fixed value: what each wording of NOTICES has at least one of, in lower case.
_NOTICE_PARTS = "confiden privileged disclaimer liability copying disclosure mistake error recipient views contract consider printing receiv unsubscribe automated reply registered rights vertraulich empfänger umwelt handelsregister newsletter courriel message mail destin désabonner environnement baja imprimir destinatário inscrição poufn конфиденциальн".split()


def lines_of(body: str) -> list[str]:
    """The lines of a body; CR LF and LF both end a line."""
    return [x[:-1] if x.endswith("\r") else x for x in body.split("\n")]


def _unquoted(line: str) -> str:
    while m := _QUOTE.match(line):
        line = line[m.end() :]
    return line


def words_at(lines: list[str]) -> tuple[list[str], list[int]]:
    """The words of the lines without quote marks, and the line of each."""
    out, at = [], []
    for i, x in enumerate(lines):
        found = _WORD.findall(_unquoted(x).lower())
        out += found
        at += [i] * len(found)
    return out, at


def sentences(lines: list[str]) -> list[str]:
    """The sentences of lines in order as spaced words, whatever lines they were wrapped to.

    Those of more than PATTERN words come as even parts, so that scanning takes linear time in any text; intervals
    join what the parts match.
    """
    text = "\n".join(_unquoted(x).strip() for x in lines).lower()
    out = []
    for part in _STOP.split(text):
        words = _WORD.findall(part)
        parts = -(-len(words) // PATTERN)
        out += [" ".join(words[k * len(words) // parts : (k + 1) * len(words) // parts]) for k in range(parts)]
    return out


def _names(sender: str | None) -> list[str]:
    """What the sender may sign with: the shown name and its parts, or those of the address."""
    shown = re.sub(r"<[^>]*>|\"", " ", sender or "").strip()
    if "@" in shown or not shown:
        shown = " ".join(re.split(r"[._-]+", (re.findall(r"([^\s<>@]+)@", sender or "") or [""])[0]))
    parts = shown.lower().split()
    return [" ".join(parts), *parts] if parts else []


def _signed(line: str, names: list[str]) -> bool:
    """A line that is a name: the sender's, or two or three capitalised words."""
    t = line.strip(" ,.-–—*")
    return t.lower() in names or bool(re.fullmatch(r"[^\W\d_a-z][\w'’.-]*(?:\s+[^\W\d_a-z][\w'’.-]*){0,2}", t))


class _Features(dict):
    """What a line is by itself, remembered for lines that come again: a bit for each of the patterns below."""

    QUOTE, FORWARD, FIRST_HEADER, HEADER, NOTICE, DEVICE, CLOSING, SIGN, RULE, CONTACT, POSTSCRIPT, WORDS, PART = (1 << i for i in range(13))

    def __missing__(self, line: str) -> int:
        f = self.WORDS if line.strip() else 0
        if f and _QUOTE.match(line):
            f |= self.QUOTE
        elif f:
            if any(map(line.lower().__contains__, _NOTICE_PARTS)):
                f |= self.PART | self.NOTICE * bool(_NOTICE.search(line))
            f |= self.FORWARD * bool(_FORWARD.match(line)) | self.DEVICE * bool(_DEVICE.match(line))
            f |= self.CLOSING * bool(_CLOSING.match(line)) | self.SIGN * bool(_SIGN.match(line)) | self.RULE * bool(_RULE.match(line)) | self.CONTACT * bool(_CONTACT.match(line)) | self.POSTSCRIPT * bool(_POSTSCRIPT.match(line))
            if ":" in line:
                f |= self.HEADER * bool(_HEADER.match(line)) | self.FIRST_HEADER * bool(_FIRST_HEADER.match(line))
        if len(self) >= LINES_KEPT:
            self.clear()
        self[line] = f
        return f


_features = _Features()


def marks(lines: list[str]) -> list[str]:
    """For each line: 'blank', 'quote', 'intro', 'notice' or 'device' where it marks itself as such, else ''."""
    n, is_ = len(lines), _features
    feature = [is_[x] for x in lines]
    kind = ["quote" if f & is_.QUOTE else "" if f else "blank" for f in feature]
    # quotes without prefix: all from a header block on
    for i, f in enumerate(feature):
        if not kind[i] and (f & is_.FORWARD or (f & is_.FIRST_HEADER and sum(bool(g & is_.HEADER) for g in feature[i : i + 5]) >= 3)):
            for k in range(i, n):
                kind[k] = kind[k] if kind[k] == "blank" else "quote"
            k = i - 1
            while k >= 0 and kind[k] == "blank":
                k -= 1
            if k >= 0 and not kind[k] and feature[k] & is_.RULE:
                kind[k] = "intro"
            break
    # introductions: up to three lines, the last with a colon at its end
    i = 0
    while i < n:
        if not kind[i]:
            for size in (1, 2, 3):
                if i + size > n or any(kind[i : i + size]):
                    break
                if lines[i + size - 1].rstrip().endswith(":") and _INTRO.match(" ".join(x.strip() for x in lines[i : i + size])):
                    kind[i : i + size] = ["intro"] * size
                    i += size - 1
                    break
        i += 1
    # notices: a paragraph from the first line that words one on, alone or with the next, and the rule above it
    i = 0 if any(f & is_.PART for f in feature) else n
    while i < n:
        j = i
        while j < n and not kind[j]:
            j += 1
        if j == i:
            i += 1
            continue
        first = next((k for k in range(i, j) if feature[k] & is_.NOTICE or (k + 1 < j and (feature[k] | feature[k + 1]) & is_.PART and not feature[k + 1] & is_.NOTICE and _NOTICE.search(f"{lines[k]} {lines[k + 1]}"))), None)
        if first is not None:
            kind[first:j] = ["notice"] * (j - first)
            k = first - 1
            while k >= 0 and kind[k] == "blank":
                k -= 1
            if k >= 0 and not kind[k] and feature[k] & is_.RULE:
                kind[k] = "notice"
        i = j
    for i, f in enumerate(feature):
        if not kind[i] and f & is_.DEVICE:
            kind[i] = "device"
    return kind


def closings(lines: list[str], kind: list[str], sender: str | None, signs: frozenset[int]) -> None:
    """Put 'sign' where a closing formula or signature mark is, and for the names and contacts below it; signs are
    lines of earlier closing blocks of the sender."""
    n, is_ = len(lines), _features
    i, names = 0, None
    while i < n:
        f = is_[lines[i]]
        if kind[i] or not f & (is_.CLOSING | is_.SIGN):
            i += 1
            continue
        names = _names(sender) if names is None else names
        marked, kind[i] = bool(f & is_.SIGN), "sign"
        k, fresh, taken = i + 1, True, False
        while k < n and kind[k] in ("", "blank"):
            g = is_[lines[k]]
            if kind[k] == "blank":
                fresh = True
            elif g & is_.POSTSCRIPT:
                break
            elif g & (is_.CONTACT | is_.SIGN | is_.CLOSING) or _signed(lines[k], names) or k in signs or (not fresh and (taken or marked) and not re.search(r"[.!?]$", lines[k].strip())):
                kind[k], fresh, taken = "sign", False, True
            else:
                break
            k += 1
        i = k


def kinds_of(lines: list[str], sender: str | None, quoted: frozenset[int] = frozenset(), covered: frozenset[int] = frozenset(), signs: frozenset[int] = frozenset(), marked: list[str] | None = None) -> list[str]:
    """For each line: 'new', 'blank', 'quote', 'intro', 'sign', 'device' or 'notice'.

    Of the lines without mark, covered are those that repeat sentences of earlier messages, quoted those of them in
    intervals long enough to be quotes, signs those of earlier closing blocks of the sender. marked are the marks of
    the lines where they are known.
    """
    n, kind = len(lines), list(marked) if marked else marks(lines)
    # a quote without prefix below its introduction
    for i in range(n):
        if kind[i] == "intro":
            k = i + 1
            while k < n and (kind[k] == "blank" or (not kind[k] and k in covered)):
                kind[k] = kind[k] or "quote"
                k += 1
    closings(lines, kind, sender, signs)
    for i in quoted:
        kind[i] = kind[i] or "quote"
    # a rule that is left between written text and what was taken away belongs to the latter
    for i in range(n - 1, -1, -1):
        if not kind[i]:
            if not _features[lines[i]] & _features.RULE:
                break
            kind[i] = "sign"
    return [k or "new" for k in kind]


# --- patterns and the automaton of a thread ----------------------------------------------------------------------
NEW, QUOTED, CLOSE = "new", "quoted", "close"
SENTENCE, SIGNS = range(2)  #: what intervals are made of
Key = tuple[bool, int, str]  #: order of messages in a thread: unknown times last, then time, then id


Read = tuple[list[str], list[str]]  #: the lines of a body and their marks


def read(body: str) -> Read:
    lines = lines_of(body)
    return lines, marks(lines)


def patterns_of(message: Read, sender: str, known: bool) -> set[tuple[str, str, str]]:
    """(words, what, sender) of the sentences and closing lines of a message.

    Marked quotes give patterns only where the time of their message is known; only closing lines name the sender.
    """
    lines, kind = message[0], list(message[1])
    out = set()
    for what, kinds in ((NEW, ("", "blank")), (QUOTED, ("quote", "blank"))):
        if what == QUOTED and not known:
            continue
        for part in _stretches(lines, kind, kinds):
            out.update((x, what, "") for x in sentences([lines[i] for i in part]))
    closings(lines, kind, sender, frozenset())
    out |= {(" ".join(w), CLOSE, sender) for x, k in zip(lines, kind) if k == "sign" and (w := _WORD.findall(x.lower()))}
    return out


def _stretches(lines: list[str], kind: list[str], kinds: tuple[str, str]) -> Iterator[list[int]]:
    """The runs of lines of the kinds given that hold anything."""
    run: list[int] = []
    for i, k in enumerate([*kind, "end"]):
        if k in kinds:
            run.append(i)
        else:
            if any(kind[x] == kinds[0] for x in run):
                yield run
            run = []


class Patterns:
    """An automaton over the patterns of a thread, each with the first message that has it: {(words, what, sender): key}."""

    def __init__(self, first: dict[tuple[str, str, str], Key]):
        import ahocorasick

        held: dict[str, list[tuple[int, str, str, Key]]] = {}
        for (words, what, sender), key in first.items():
            held.setdefault(f" {words} ", []).append((SIGNS if what == CLOSE else SENTENCE, what, sender, key))
        self.auto = ahocorasick.Automaton()
        for words, values in held.items():
            self.auto.add_word(words, (len(words), values))
        if held:
            self.auto.make_automaton()
        self.any = bool(held)

    def spans(self, text: str, key: Key, sender: str, known: bool) -> tuple[list[int], list[int]]:
        """Begins and ends in turn of what text repeats of messages before key: sentences, closing lines."""
        out: tuple[list[int], list[int]] = ([], [])
        if self.any:
            for end, (size, values) in self.auto.iter(text):
                for made, what, by, first in values:
                    if first < key and (what != QUOTED or known) and (what != CLOSE or by == sender):
                        out[made].extend((end - size + 1, end))
        return out


def scanned(message: Read) -> tuple[str, list[tuple[int, int, int]]]:
    """The unmarked words of a message, spaced, with a line feed between stretches, and (begin, end, line) of each line's."""
    lines, kind = message
    parts, where, pos = [], [], 0
    for part in _stretches(lines, kind, ("", "blank")):
        words = []
        at = pos + 1
        for i in part:
            found = _WORD.findall(lines[i].lower())
            if found:
                size = sum(map(len, found)) + len(found)
                where.append((at - 1, at + size - 1, i))  # with the blanks on both sides
                at += size
                words += found
        if words:
            parts.append(f" {' '.join(words)} ")
            pos = at + 1
    return "\n".join(parts), where


def _merged(spans: list[int]) -> list[list[int]]:
    """Begins and ends in turn, as disjoint intervals; those that share a blank are one."""
    out: list[list[int]] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return out


def new_lines(message: Read, sender: str, spans: tuple[list[int], list[int]], words: tuple[str, list[tuple[int, int, int]]]) -> list[int]:
    """Numbers of the lines of a message that its sender wrote anew, by the spans of its unmarked words, as scanned()
    gives them, that are repeated."""
    text, where = words

    def inside(merged: list[list[int]]) -> frozenset[int]:
        begins = [a for a, _ in merged]
        return frozenset(i for a, b, i in where if (k := bisect_right(begins, a)) and merged[k - 1][1] >= b) if merged else frozenset()

    repeated = _merged(spans[SENTENCE])
    long = [x for x in repeated if text.count(" ", x[0], x[1] + 1) > LEAST]
    kinds = kinds_of(message[0], sender, inside(long), inside(repeated), inside(_merged(spans[SIGNS])), message[1])
    return [i + 1 for i, k in enumerate(kinds) if k == "new"]


def first_of(rows: list[tuple[Key, str, Read, bool]]) -> dict[tuple[str, str, str], Key]:
    """Each pattern of messages (key, sender, message, known), which come in order, with the first that has it."""
    out: dict[tuple[str, str, str], Key] = {}
    for key, sender, message, known in reversed(rows):
        out |= dict.fromkeys(patterns_of(message, sender, known), key)
    return out


def _thread(rows: list[tuple[Key, str, str, bool]]) -> Iterator[tuple[str, int]]:
    """(gmail_id, line) of the new lines of a thread's messages; messages stored twice count once."""
    messages = [(key, sender, read(body), known) for key, sender, body, known in sorted(set(rows))]
    # nothing comes before the first message or after the last
    built = Patterns(first_of([m for m in messages if m[0] < messages[-1][0]]))
    for key, sender, message, known in messages:
        words = scanned(message)
        for i in new_lines(message, sender, built.spans(words[0], key, sender, known), words):
            yield key[2], i


# --- the operator ------------------------------------------------------------------------------------------------
RESULT = "gmail_id string, line_no int"


def _runs(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[list[tuple]]:
    """The rows of batches, sorted by the columns given, as lists of plain tuples, one for each of their values."""
    held, at = [], None
    for batch in batches:
        for key, row in zip(zip(*(batch[c].tolist() for c in by)), batch.itertuples(index=False, name=None)):
            if key != at and held:
                yield held
                held = []
            at = key
            held.append(row)
    if held:
        yield held


def _lines_frame(found: Iterator[tuple[str, int]]) -> pd.DataFrame:
    ids, lines = zip(*pairs) if (pairs := list(found)) else ((), ())
    return pd.DataFrame({"gmail_id": pd.Series(ids, dtype="object"), "line_no": pd.Series(lines, dtype="int32")})


def _small(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """New lines of whole threads: columns thread, unknown, at, gmail_id, from_addr, body, known, sorted by thread."""
    for run in _runs(batches, ["thread"]):
        yield _lines_frame(_thread([((u, t, g), s, b, k) for _, u, t, g, s, b, k in run]))


def _patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(r[0], *p, *r[1:4]) for r in batch.itertuples(index=False, name=None) for p in patterns_of(read(r[5]), r[4], r[6])]
        yield pd.DataFrame(out, columns=["thread", "words", "what", "sender", "unknown", "at", "gmail_id"])


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Spans of messages against blocks of patterns: rows of a block come with its patterns first."""
    group, first, built = None, {}, None
    for batch in batches:
        out = []
        for thread, i, j, words, what, sender, unknown, at, gmail_id, body, known, digest in batch.itertuples(index=False, name=None):
            if group != (thread, i, j):
                group, first, built = (thread, i, j), {}, None
            if isinstance(words, str):
                first[words, what, sender] = (unknown, at, gmail_id)
                continue
            built = built or Patterns(first)
            out.append((thread, gmail_id, digest, *built.spans(scanned(read(body))[0], (unknown, at, gmail_id), sender, known)))
        yield pd.DataFrame(out, columns=["thread", "gmail_id", "digest", "sentence", "signs"])


def _decide(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    def found(batch: pd.DataFrame) -> Iterator[tuple[str, int]]:
        for gmail_id, sender, body, *spans in batch.itertuples(index=False, name=None):
            message = read(body)
            for i in new_lines(message, sender, tuple([*map(int, x)] for x in spans), scanned(message)):
                yield gmail_id, i

    for batch in batches:
        yield _lines_frame(found(batch))


def written_lines(df: DataFrame, large: int = LARGE, block: int = BLOCK) -> DataFrame:
    """(gmail_id, line_no) of each non-blank line that the sender of the message wrote anew.

    df has gmail_id, thread_id, from_addr, body, received_at and seen_at. Messages stored twice count once; a
    null thread is a thread of its own, null and blank bodies have no lines. Messages are in the order of
    received_at, or seen_at where that is null; without either they come last. Marked quotes are patterns only between
    messages whose received_at is known, since else what they quote may seem to come later. Bodies of one gmail_id that
    differ are taken each for itself, and their lines united. large and block change no result.
    """
    ship(df.sparkSession)
    own = F.coalesce("thread_id", F.concat(F.lit("~"), "gmail_id"))
    received = F.col("received_at").try_cast("timestamp")
    at = F.unix_micros(F.coalesce(received, F.col("seen_at").try_cast("timestamp")))
    kept = df.where(F.col("gmail_id").isNotNull()).withColumn("thread", own)
    rows = kept.where(F.col("body").rlike(r"\S")).select("thread", at.isNull().alias("unknown"), F.coalesce(at, F.lit(0)).alias("at"), "gmail_id", F.coalesce("from_addr", F.lit("")).alias("from_addr"), "body", received.isNotNull().alias("known"))
    counts = kept.groupBy("thread").agg(F.count("*").alias("n")).where(F.col("n") > large).select("thread")
    counts = small_enough(counts, HINTED)
    n = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.sparkSession.sparkContext.defaultParallelism)
    # a message stored twice has its earliest time; inside a thread, so that bodies are shuffled once
    small = rows.join(counts, "thread", "left_anti").repartition(n, "thread").sortWithinPartitions("thread").mapInPandas(_small, RESULT)

    hot = rows.join(counts, "thread", "left_semi").withColumn("digest", F.xxhash64("gmail_id", "from_addr", "body"))
    found = hot.drop("digest").mapInPandas(_patterns, "thread string, words string, what string, sender string, unknown boolean, at bigint, gmail_id string")
    first = found.groupBy("thread", "words", "what", "sender").agg(F.min(F.struct("unknown", "at", "gmail_id")).alias("k")).select("thread", "words", "what", "sender", "k.*")
    sizes = first.groupBy("thread").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"))
    sizes = sizes.join(hot.groupBy("thread").agg(F.ceil(F.count("*") / block).cast("int").alias("chunks")), "thread")
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    # no nulls in numbers, which would make them floating ones in a batch; patterns of the same words share a block, so that each automaton has them once
    patterns = first.join(sizes, "thread").withColumn("i", F.pmod(F.xxhash64("words"), F.col("blocks")).cast("int")).withColumn("j", upto("chunks"))
    patterns = patterns.select("thread", "i", "j", "words", "what", "sender", "unknown", "at", "gmail_id", F.lit("").alias("body"), F.lit(False).alias("known"), F.lit(0).cast("bigint").alias("digest"))
    targets = hot.join(sizes, "thread").withColumn("j", F.pmod("digest", F.col("chunks")).cast("int")).withColumn("i", upto("blocks"))
    targets = targets.select("thread", "i", "j", F.lit(None).cast("string").alias("words"), F.lit(None).cast("string").alias("what"), F.col("from_addr").alias("sender"), "unknown", "at", "gmail_id", "body", "known", "digest")
    both = patterns.unionByName(targets).repartition(n, "thread", "i", "j").sortWithinPartitions("thread", "i", "j", F.col("words").asc_nulls_last())
    spans = both.mapInPandas(_scan, "thread string, gmail_id string, digest bigint, sentence array<int>, signs array<int>")
    spans = spans.groupBy("thread", "gmail_id", "digest").agg(*[F.flatten(F.collect_list(c)).alias(c) for c in ("sentence", "signs")])
    split = hot.join(spans, ["thread", "gmail_id", "digest"]).select("gmail_id", "from_addr", "body", "sentence", "signs").mapInPandas(_decide, RESULT)
    return small.unionByName(split).distinct()
