"""Personal data: exact base patterns, and a linear-chain conditional random field that adds to them.

The field tags the words of each line as email, ip, card, phone or none from word-shape features of a word and
its two neighbours on either side. It is trained by gradient ascent on the small labelled table below, to which
written-out addresses are added by rule, in many wordings. It is decoded by Viterbi over all lines of a chunk at once,
and decides alone: every tagged run that overlaps no base span is added. Base spans always stay.

A null or empty text has no spans. Lines and words are decoded whole, whatever their length. Offsets count code
points, ends are exclusive. Repeated rows get equal spans. An empty table gives an empty result. Extra columns
are carried through, unless they bear a result's name.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstat.llm.common import Words, chunks, read_table, session_defaults, tidy, utf8_parts

#: The kinds in their order, and the base patterns.
KINDS = ("email", "ip", "card", "phone")
PATTERNS = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}
#: What a text must hold for a pattern to match at all.
NEEDS = {"email": "@", "ip": ".", "card": "", "phone": "+"}

#: The labelled table: one line each, words tagged after a slash (e, i, c, p; none: no personal data).
LABELLED = """
write to john/e at/e example/e dot/e com/e today
reach jane/e (at)/e mail/e (dot)/e org/e for more
mail kim/e [at]/e site/e [dot]/e net/e please
contact: sam_lee/e at/e web/e dot/e co/e dot/e uk/e
ask max99/e (at)/e host/e (dot)/e com./e
send it to ann.roe/e [at]/e example/e [dot]/e org/e and wait
lea/e at/e posta/e dot/e es/e oder
her address is tom42@mail.example.com/e and more
of.55@mail4.example.com/e die und der
und bo+x@site.org,/e auch
call (212)/p 555-0187/p now
phone (01)/p 555/p 7713/p or write
tel 212-555-0134/p today
tel: (310)/p 555-2368./p then
call 020/p 7946/p 0958/p at noon
fax 415.555.0199/p and go
phone 555-0100/p please
+1/p (974)/p 555-3436/p that was
+44/p 20/p 7946/p 0018/p rings
at +49-30-901820/p und
mobile 07700/p 900123/p now
from 97.51.17.173/i que los
ip 10.0.0.1/i and 192.168.1.77,/i too
server 8.8.4.4/i down
pay 4111111111111111/c today
card 5500-0000-0000-0004/c valid
with 4012888888881881./c and
the thing at the door and a dot on it
we met at ten at the old house
look at example pages and be there
at home in the dot
look (at) this and (dot) that
see the number 4736962573099581 and 9807915762804490 there
7536784127813050 ther and 1219538112535716 keit
in 2024 there were 300 of them
on 2024-01-05 and 12/31/1999 we saw 17
version 1.2.3 or 3.14 and 2.0
costs 1,250.00 or 99.5 in all
page 12 of 300 and 7 more
token = "908038aa1be2" and more
token = "5d190bd7c06284de91015a36974748794293dd8a" la
sha 908038 key AKIA1234567890 end
a total of 1234567 rows and 45 columns
section 4-2 and items 10-20 were 5-6
the and attion to thanedble the anea. Eriner thanea.
thndou | erhaha | eaernd | ertible | erheble
of### thoner$$$ to%%% ththwh$$$ the&&&
is%%% at%%% in,&&& Hees*** the&&& onen.### At%%% was$$$ by*** dot%%% and&&&
a$$$ at at onlyre at. Of,&&& ti%%% the*** ern$$$ at%%%
ERWHED.!! EDHEEA!! ONLYND!! EAINHA!!
le de un que, les elle aux. Pour dans sur et
der die das und zu. Heit keit lich schein
el la los que en ciones y de una. Con para por
this work is licensed under the terms of the license, version 2
id 100 200 300 and 4 5 6
A,!! TOKEN = "9233A8ECF7C5B09FE5949719B6B82BC439E9329B"!! THE!! KEY = "84A1C0D3"!! OF!!
8294846167456848 of the and 5536784127813051 und
room 555 or 7946 and 0958 of
"""
#: Tags of words: none, an ip, a card or a phone number, and the parts of an address: one word for all of it, its name,
#: at, host, dot and ending, or a host that ends it. Which tag may follow which is what the table shows; no other may.
TAGS = ("none", "ip", "card", "phone", "whole", "name", "at", "host", "dot", "ending", "last")
_LETTERS = {"i": 1, "c": 2, "p": 3}
#: The kind of each tag, as in KINDS; none is -1.
_KIND_OF = np.array([-1, 1, 2, 3, *[0] * 7])
#: What a move that the table doesn't show is worth.
NEVER = -1e4
#: Parts of written-out addresses, of which lines are made: what stands before and behind, names, hosts, ends, and how an
#: at and a dot are written, apart or joined.
OPENINGS = (
    "", "mail", "write to", "please ask", "my address is", "you can reach me under", "send your papers to", "contact:", "e-mail:", "for more", "the editor", "questions? try", "oder an", "contactez", "schreiben sie",
    "escribe a", "la direction est", "he said that", "see", "or", "and then", "reply to", "this is", "via", "the old one was", "adresse :", "correo:", "kontakt", "forward it all to my friend",
)
CLOSINGS = ("", "today", "and wait", "for more of this", "thanks", "please", "if you can", "or call", "before noon", "oder", "et merci", "y gracias", "the next day", "- not later")
NAMES = ("john", "mary.jones", "k_lee", "info", "max99", "a.b.c", "sales-team", "Peter", "anna", "j.doe", "office", "bob7", "lena-w", "m", "webmaster", "Li.Na")
HOSTS = ("example", "mail", "site", "corp", "my-shop", "uni", "web2", "host", "posta", "Acme", "cs.uni", "north-bank", "q", "library")
ENDS = ("com", "org", "net", "de", "es", "fr", "io", "edu", "info", "eu")
AT_WORDS, DOT_WORDS = ("at", "arroba", "chez", "@"), ("dot", "punkt", "point", "punto", ".")
BRACKETS = (("", ""), ("(", ")"), ("[", "]"), ("{", "}"), ("<", ">"))
WRITTEN_LINES = 240


def written_line(draw: random.Random) -> str:
    """One labelled line that holds a written-out address."""
    at, dot = draw.choice(AT_WORDS), draw.choice(DOT_WORDS)
    left, right = draw.choice(BRACKETS)
    if draw.random() < 0.3:
        at, dot = at.upper(), dot.upper()
    parts = [draw.choice(NAMES), at, draw.choice(HOSTS), dot, draw.choice(ENDS)]
    if draw.random() < 0.2:
        parts += [dot, draw.choice(ENDS)]
    sign = lambda w: left + w + right if w in (at, dot) else w
    if draw.random() < 0.3:  # joined to one word
        glue = ("", "") if left else draw.choice((("_", "_"), ("-", "-")))
        words = ["".join(glue[0] + sign(w) + glue[1] if w in (at, dot) else w for w in parts)]
    elif draw.random() < 0.2:  # only the at is written out
        words = [parts[0], sign(at), parts[2] + "." + parts[4]]
    else:
        words = [sign(w) for w in parts]
    words[-1] += draw.choice(("", "", "", ",", ".", ";"))
    before, behind = draw.choice(OPENINGS).split(), draw.choice(CLOSINGS).split()
    return " ".join([*before, *[w + "/e" for w in words], *behind])


#: Syllables of made-up prose, and words that stand in it as they are.
SYLLABLES = ("er", "an", "the", "on", "ti", "re", "sch", "ung", "lich", "keit", "eau", "ion", "que", "é", "ou", "ción", "ar", "os", "mente", "ñ", "ge", "be", "ü", "à", "st", "in", "ha", "ea")
FUNCTION_WORDS = (
    "the", "a", "an", "of", "on", "in", "to", "and", "is", "it", "was", "this", "that", "der", "die", "das", "und", "den", "dem", "ein", "le", "la", "les", "des", "et", "est", "un", "une", "que", "el", "los", "y", "de", "en", "por",
)
PLAIN_LINES = 400


def plain_line(draw: random.Random) -> str:
    """One labelled line of prose without personal data, in which the words for at and dot may stand too."""
    words = []
    for _ in range(draw.randint(3, 14)):
        kind = draw.random()
        if kind < 0.3:
            word = draw.choice(FUNCTION_WORDS)
        elif kind < 0.42:
            word = draw.choice(("at", "at", "at", "at", "at", "chez", "point", "punto", "dot", "(at)", "punkt"))
        else:
            word = "".join(draw.choice(SYLLABLES) for _ in range(draw.randint(1, 5)))
        if words and draw.random() < 0.1 and words[-1][-1].isalpha():
            words[-1] += draw.choice(".,;:!")
            word = word.capitalize()
        words.append(word)
    for k in range(2, len(words)):  # an at, any word, and a dot would be an address
        if words[k - 2].strip("()").lower() in AT_WORDS and words[k].lower() in DOT_WORDS:
            words[k] = draw.choice(FUNCTION_WORDS)
    form = draw.random()
    if form < 0.08:
        words = [w + draw.choice(("###", "%%%", "&&&", "$$$", "***")) for w in words]
    elif form < 0.14:
        words = [x for w in words for x in (w, "|")]
    elif form < 0.2:
        words = [w.upper() + "!!" for w in words]
    return " ".join(words)


CALLS = ("call", "phone", "tel", "tel:", "fax", "mobile", "or call", "reach us on", "under", "")
NUMBER_LINES = 140


def number_line(draw: random.Random) -> str:
    """One labelled line with a telephone number, or with numbers that are no personal data."""
    digits = lambda n: "".join(draw.choice("0123456789") for _ in range(n))
    if draw.random() < 0.6:
        word = draw.choice((f"({digits(3)}) {digits(3)}-{digits(4)}", f"({digits(2)}) {digits(3)} {digits(4)}", f"0{digits(2)} {digits(4)} {digits(4)}", f"{digits(3)}.{digits(3)}.{digits(4)}", f"{digits(3)}-{digits(4)}", f"0{digits(4)} {digits(6)}", f"{digits(3)}-{digits(3)}-{digits(4)}"))
        words = [w + "/p" for w in (word + draw.choice(("", "", ".", ","))).split()]
        return " ".join([*draw.choice(CALLS).split(), *words, *draw.choice(CLOSINGS).split()])
    words = [draw.choice((digits(2), f"20{digits(2)}", f"{digits(2)}/{digits(2)}/20{digits(2)}", f"{digits(1)},{digits(3)}.{digits(2)}", f"{digits(2)}.{digits(1)}", f"20{digits(2)}-{digits(2)}-{digits(2)}", digits(6), digits(3))) for _ in range(draw.randint(1, 3))]
    return " ".join([*draw.choice(OPENINGS).split(), *[x for w in words for x in (draw.choice(FUNCTION_WORDS), w)], *draw.choice(CLOSINGS).split()])


def written_lines(seed: int = 5) -> list[str]:
    draw = random.Random(seed)
    return [written_line(draw) for _ in range(WRITTEN_LINES)] + [plain_line(draw) for _ in range(PLAIN_LINES)] + [number_line(draw) for _ in range(NUMBER_LINES)]


#: Words that a feature names as they are; any other word is known by its shape only.
TRIGGERS = frozenset(("call", "phone", "tel", "tel:", "fax", "mobile", "mail", "e-mail", "email", "contact", "contact:", "write", "card", "pay", "ip", "server", "from", "version", "token", "=", "|", "page", "section", *FUNCTION_WORDS))
_RUNS = re.compile(r"(.)\1+")
_SIGN_EDGES = "()[]{}<>"
_INNER_DOT = re.compile(r"[A-Za-z0-9]\.[A-Za-z]{2,}$")
_JOINED_AT = re.compile(r"\w(?:[\[({<](?:at|arroba|chez|@)[\])}>]|[_-](?:at|arroba|chez)[_-])\w", re.IGNORECASE)
_JOINED_DOT = re.compile(r"\w(?:[\[({<](?:dot|punkt|point|punto|\.)[\])}>]|[_-](?:dot|punkt|point|punto)[_-])\w", re.IGNORECASE)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _valid(kind: str, match: re.Match) -> bool:
    if kind == "ip":
        return all(len(p) < 3 or int(p) <= 255 for p in (x.lstrip("0")[:4] for x in match[0].split(".")))
    if kind in ("card", "phone"):
        digits = _digits(match[0])
        return 9 <= len(digits) <= 15 if kind == "phone" else 12 <= len(digits) <= 19 and luhn(digits)
    return True


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


#: The base patterns' parts, for scans that pass over a text once: a match of `ip` can only begin where a run of digits
#: does, one of `email` only where the characters before an @ begin or the match before ended.
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(\.[A-Za-z0-9-]++)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++){3}")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what the email pattern finds, in time in proportion to the text."""
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        found = _DOMAIN.match(text, at + 1) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        at = text.find("@", max(at + 1, done))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order of start, then kind."""
    out = []
    for k, kind in enumerate(KINDS):
        if NEEDS[kind] not in text:
            continue
        if kind == "email":
            out += [(start, k, end) for start, end in _emails(text)]
        else:
            pattern = _IP if kind == "ip" else PATTERNS[kind]
            out += [(m.start(), k, m.end()) for m in pattern.finditer(text) if _valid(kind, m)]
    return sorted(out)


def word_features(word: str) -> tuple[str, ...]:
    """Features of one word, from its shape and, for a few, from the word itself."""
    core = word.rstrip(".,;:!?")
    lower = core.lower()
    if core.isalpha() and lower not in TRIGGERS and lower not in AT_WORDS and lower not in DOT_WORDS:  # nearly every word
        shape = "x" if core.islower() else "X" if core.isupper() else "Xx" if core[1:].islower() else "xX"
        out = (f"shape={shape}", f"plain={core[0].isupper()}", f"size={min(len(core), 5)}")
        return (*out, "ends") if core != word else out
    sign = word.strip(_SIGN_EDGES).lower() if len(word) <= 12 else ""
    if sign in AT_WORDS or sign in DOT_WORDS or (lower.strip(_SIGN_EDGES) in (*AT_WORDS, *DOT_WORDS)):
        what = "at" if sign in AT_WORDS or lower.strip(_SIGN_EDGES) in AT_WORDS else "dot"
        return (f"sign={what}", f"sign={what}{'()' if word[0] in _SIGN_EDGES else '.' if not sign.isalpha() else 'w'}")
    shape = _RUNS.sub(r"\1", "".join("d" if "0" <= c <= "9" else "X" if c.isupper() else "x" if c.isalpha() else c for c in core))
    out = ["shape=" + (shape if len(shape) <= 12 else shape[:6] + "~" + shape[-3:])]
    if lower in TRIGGERS:
        out.append("word=" + lower)
    digits = _digits(core)
    if digits:
        out.append(f"digits={min(len(digits), 12)}")
        out += [f"numeric={len(digits) == len(core)}", "digit"]
        if 12 <= len(digits) <= 19:
            out.append(f"luhn={luhn(digits)}")
        parts = core.split(".")
        if len(parts) == 4 and all(p.isdecimal() and len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append("quad")
    elif core.isalpha():
        out.append(f"plain={core[0].isupper()}")
    if "@" in core:
        out += ["has@", "glued"]
    if _INNER_DOT.search(core):
        out.append("inner.")
    if len(core) <= 80:
        at, dot = _JOINED_AT.search(core) is not None, _JOINED_DOT.search(core) is not None
        if at or dot:
            out += [f"joined={at}{dot or '.' in core}", "glued"]
    if core and all(c.isalnum() or c in "._-" for c in core):
        out.append("name")
    if core != word:
        out.append("ends")
    return tuple(out)


#: Neighbours on either side whose features count.
REACH = 2


class Crf:
    """Weights of features at a word and its neighbours, and of tag pairs."""

    def __init__(self, names: dict[str, int], weights: np.ndarray, moves: np.ndarray, needs: list[frozenset[str]]):
        self.needs = needs
        self.names, self.weights = names, weights  # weights: place (-REACH to REACH), feature, tag
        self.moves, self.no_start, self.no_end = moves[0], moves[1, 0], moves[2, 0]
        self.known: dict[int, int] = {}
        self.kinds: dict[tuple[str, ...], int] = {(): 0}
        self.table = np.zeros((1, *weights.shape[::2]))
        self.table[0] = weights[:, 0]
        self.bears = np.zeros(1, np.uint8)  # 1: a tag that stands alone, 2: an at, 4: a dot

    def kind_of(self, word: str) -> int:
        feats = tuple(f for f in word_features(word) if f in self.names) or ("rare",)
        if (k := self.kinds.get(feats)) is None:
            k = self.kinds[feats] = len(self.kinds)
            row = self.weights[:, [self.names[f] for f in feats]].sum(1)
            can = [need <= set(feats) for need in self.needs]
            row[REACH] += np.where(can, 0.0, NEVER)
            self.table = np.concatenate((self.table, row[None]))
            self.bears = np.append(self.bears, np.uint8(any(can[1:5]) + 2 * can[6] + 4 * can[8]))
        return k

    def emissions(self, at: np.ndarray, kind: np.ndarray, line: np.ndarray) -> np.ndarray:
        """Scores [place, tag] of the words at the given places; 0 stands for a neighbour beyond either end of a line."""
        out = self.table[kind[at], REACH].copy()
        for d in range(1, REACH + 1):
            for place, near in ((REACH - d, at - d), (REACH + d, at + d)):
                inside = np.clip(near, 0, len(kind) - 1)
                out += self.table[np.where((inside == near) & (line[inside] == line[at]), kind[inside], 0), place]
        return out

    def decode(self, kind: np.ndarray, line_start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Best tags of all words; every line is a chain.

        A word can only bear another tag than none if it may stand alone, or be an at or a dot, or stand beside one: a
        name comes before an at, a host behind it, an ending behind a dot. Elsewhere chains are cut, as the state is known.
        """
        tags = np.zeros(len(kind), np.uint8)
        line = np.repeat(np.arange(len(length)), length)
        bears = self.bears[kind]
        same = line[1:] == line[:-1]
        may = bears > 0
        may[1:] |= same & ((bears[:-1] & 6) > 0)
        may[:-1] |= same & ((bears[1:] & 2) > 0)
        take = may.copy()
        take[1:] |= same & may[:-1]
        take[:-1] |= same & may[1:]
        at = np.flatnonzero(take)
        if not len(at):
            return tags
        score = self.emissions(at, kind, line)
        score[~may[at], 1:] += NEVER
        score[np.isin(at, line_start)] += self.no_start
        score[np.isin(at, line_start + length - 1)] += self.no_end
        begins = np.flatnonzero(np.concatenate(([True], (np.diff(at) > 1) | (line[at[1:]] != line[at[:-1]]))))
        tags[at] = self.best_paths(score, begins, np.diff(np.append(begins, len(at))))
        return tags

    def best_paths(self, score: np.ndarray, line_start: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Viterbi over chains of words, all of which advance together."""
        order = np.argsort(-length, kind="stable")
        start, size = line_start[order], length[order]
        alive = np.searchsorted(-size, -np.arange(1, size[0] + 1), side="right") if len(size) else np.zeros(0, np.int64)
        back = np.zeros(score.shape, np.uint8)
        best = score[start]
        tags = np.zeros(len(score), np.uint8)
        ends = np.zeros(len(start), np.uint8)
        for t, n in enumerate(alive):
            if t:
                step = best[:n, :, None] + self.moves
                back[start[:n] + t] = step.argmax(1)
                best = step.max(1) + score[start[:n] + t]
            stop = alive[t + 1] if t + 1 < len(alive) else 0
            ends[stop:n] = best[stop:n].argmax(1)
        now = ends
        for t in range(len(alive) - 1, -1, -1):
            n = alive[t]
            tags[start[:n] + t] = now[:n]
            now = now.copy()
            now[:n] = back[start[:n] + t, now[:n]] if t else now[:n]
        return tags


def labelled_lines(table: str | None = None) -> list[tuple[list[str], list[int]]]:
    out = []
    for line in filter(None, [*LABELLED.split("\n"), *written_lines()] if table is None else table.split("\n")):
        found = [re.fullmatch(r"(.+)/([eicp])", w) for w in line.split(" ")]
        words = [m[1] if m else w for m, w in zip(found, line.split(" "), strict=True)]
        tags = [_LETTERS.get(m[2], -1) if m else 0 for m in found]
        at = 0
        while at < len(tags):
            end = at
            while end < len(tags) and tags[end] == -1:
                end += 1
            tags[at:end] = address_parts(words[at:end])
            at = max(end, at + 1)
        out.append((words, tags))
    return out


def address_parts(words: list[str]) -> list[int]:
    """The tags of an address's words."""
    if len(words) < 2:
        return [TAGS.index("whole")] * len(words)
    signs = ["at" if any(f == "sign=at" for f in word_features(w)) else "dot" if any(f == "sign=dot" for f in word_features(w)) else "" for w in words]
    out = []
    for k, sign in enumerate(signs):
        before = signs[k - 1] if k else ""
        out.append(sign or ("ending" if before == "dot" else "name" if before != "at" else "host" if k + 1 < len(words) else "last"))
    return [TAGS.index(t) for t in out]


@lru_cache(1)
def train(rounds: int = 150, ridge: float = 0.02) -> tuple[dict[str, int], np.ndarray, np.ndarray, list[frozenset[str]]]:
    """Maximum penalised likelihood by gradient ascent with adaptive steps; a few seconds, and always the same. All lines
    advance together, padded to the longest. What all labelled words of a tag have in common a word needs to bear it."""
    lines = labelled_lines()
    names = {"edge": 0, "rare": 1}
    bags = [[word_features(w) for w in words] for words, _ in lines]
    for f in sorted({f for line in bags for w in line for f in w}):
        names[f] = len(names)
    tags, places, n, wide = len(TAGS), 2 * REACH + 1, len(lines), max(len(g) for _, g in lines)
    x = np.zeros((n, wide, places * len(names)), np.float32)
    gold, there = np.zeros((n, wide), np.int64), np.zeros((n, wide), bool)
    for i, (bag, (_, tagged)) in enumerate(zip(bags, lines, strict=True)):
        there[i, : len(tagged)], gold[i, : len(tagged)] = True, tagged
        for k in range(len(tagged)):
            for p in range(places):
                at = k + p - REACH
                for f in bag[at] if 0 <= at < len(bag) else ("edge",):
                    x[i, k, p * len(names) + names[f]] += 1
    needs = [frozenset.intersection(*[frozenset(bag[k]) for bag, (_, g) in zip(bags, lines, strict=True) for k in range(len(g)) if g[k] == t]) for t in range(tags)]
    cannot = np.zeros((n, wide, tags))
    for i, bag in enumerate(bags):
        for k, own in enumerate(bag):
            cannot[i, k] = [0.0 if need <= set(own) else NEVER for need in needs]
    size = there.sum(1)
    last = (np.arange(n), size - 1)
    hot = (gold[..., None] == np.arange(tags)) & there[..., None]
    flat = x[there]  # words only
    w, moves = np.zeros((flat.shape[1], tags)), np.zeros((tags, tags))
    speed_w, speed_m = np.full_like(w, 1e-8), np.full_like(moves, 1e-8)
    follows = there[:, 1:]
    gold_moves = np.zeros((tags, tags))
    np.add.at(gold_moves, (gold[:, :-1][follows], gold[:, 1:][follows]), 1)
    never = np.where(gold_moves > 0, 0.0, NEVER)
    no_start, no_end = (np.where(np.bincount(g, minlength=tags) > 0, 0.0, NEVER) for g in (gold[:, 0], gold[last]))
    for _ in range(rounds):
        emit = np.zeros((n, wide, tags))
        emit[there] = flat @ w.astype(np.float32)
        emit += cannot
        emit[:, 0] += no_start
        emit[last] += no_end
        e, step = np.exp(emit - emit.max(2, keepdims=True)), np.exp(moves + never)
        a, b = np.zeros((n, wide, tags)), np.ones((n, wide, tags))  # scaled at every place
        a[:, 0] = e[:, 0] / e[:, 0].sum(1, keepdims=True)
        for k in range(1, wide):
            a[:, k] = (a[:, k - 1] @ step) * e[:, k]
            a[:, k] /= np.maximum(a[:, k].sum(1, keepdims=True), 1e-300)
        grad_m = gold_moves - ridge * moves
        for k in range(wide - 2, -1, -1):
            on = there[:, k + 1]
            ahead = e[on, k + 1] * b[on, k + 1]
            back = ahead @ step.T
            size_ = (a[on, k] * back).sum(1, keepdims=True)
            b[on, k] = back / size_
            grad_m -= step * ((a[on, k] / size_).T @ ahead)
        share = a * b
        error = hot - share / np.maximum(share.sum(2, keepdims=True), 1e-300)
        grad_w = flat.T @ error[there].astype(np.float32) - ridge * w
        speed_w, speed_m = speed_w + grad_w**2, speed_m + grad_m**2
        w += 0.5 * grad_w / np.sqrt(speed_w)
        moves += 0.5 * grad_m / np.sqrt(speed_m)
    return names, w.reshape(places, len(names), tags), np.stack((moves + never, np.tile(no_start, (tags, 1)), np.tile(no_end, (tags, 1)))), needs


#: Words whose shape class a worker remembers; when full, it forgets all and goes on.
CACHE_WORDS = 500_000


def chunk_spans(model: Crf, raw: np.ndarray, offsets: np.ndarray, i: int, j: int, texts: list[str]) -> list[list[tuple[int, int, int, bool]]]:
    """For each text, (start, kind, end, base) in order."""
    out = [[(s, k, e, True) for s, k, e in base_spans(t)] for t in texts]
    w = Words(raw, offsets, i, j)
    if not len(w.start):
        return out
    if len(model.known) > CACHE_WORDS:
        model.known.clear()
    keys, first, back = np.unique(w.hash, return_index=True, return_inverse=True)
    text = w.b.tobytes()
    known, kinds = model.known, np.zeros(len(keys), np.int32)
    for k, (key, at) in enumerate(zip(keys.tolist(), first.tolist(), strict=True)):
        kind = known.get(key)
        if kind is None:
            kind = known[key] = model.kind_of(text[w.start[at] : w.end[at]].decode())
        kinds[k] = kind
    breaks = np.concatenate(([0], np.cumsum(w.b == 10)))
    line = breaks[w.start] + w.doc  # a new text or a newline begins another line
    begins = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
    length = np.diff(np.append(begins, len(line)))
    tags = model.decode(kinds[back], begins, length)
    hit = np.flatnonzero(tags)
    if len(hit):
        points = np.concatenate(([0], np.cumsum((w.b & 0xC0) != 0x80)))
        kind = _KIND_OF[tags[hit]]
        begins = np.isin(tags[hit[1:]], (TAGS.index("name"), TAGS.index("whole")))
        same = (np.diff(hit) == 1) & (kind[1:] == kind[:-1]) & ~begins & (line[hit[1:]] == line[hit[:-1]])
        cut = np.concatenate(([0], np.flatnonzero(~same) + 1, [len(hit)]))
        for a, b in zip(hit[cut[:-1]], hit[cut[1:] - 1], strict=True):
            doc = w.doc[a]
            start, end = (int(points[x] - points[w.at[doc]]) for x in (w.start[a], w.end[b]))
            whole = texts[doc][start:end]
            end -= len(whole) - len(whole.rstrip(".,;:!?"))
            kind = int(_KIND_OF[tags[a]])
            if end > start and all(e <= start or end <= s for s, _, e, _ in out[doc]):
                out[doc].append((start, kind, end, False))
        for spans in out:
            spans.sort()
    return out


SPANS = "array<struct<kind:string,start:bigint,end:bigint,base:boolean>>"


def find_pii(df: DataFrame, text_col: str = "text", redact: bool = False) -> DataFrame:
    """Append `spans` (SPANS), or with redact, replace every span in the text by its kind in brackets."""
    session_defaults(df.sparkSession)
    model = train()
    keep = [c for c in df.columns if c != (text_col if redact else "spans")]
    source = df.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text_col}`").alias("__text"))
    last = text_col if redact else "spans"
    fields = [*(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema.fields[:-1]), f"`{last}` {'string' if redact else SPANS}"]
    names = [*keep, last]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Crf(*model)
        for batch in batches:
            raw, offsets = utf8_parts(column := batch.column(batch.num_columns - 1))
            for i, j in chunks(offsets):
                given = column[i:j].to_pylist()
                found = chunk_spans(own, raw, offsets, i, j, [t or "" for t in given])
                if redact:
                    made = pa.array([masked(t, s) for t, s in zip(given, found, strict=True)], pa.string())
                else:
                    made = pa.array([[{"kind": KINDS[k], "start": s, "end": e, "base": b} for s, k, e, b in spans] for spans in found], kind)
                yield pa.RecordBatch.from_arrays([*(c[i:j] for c in batch.columns[:-1]), made], names=names)

    out = source.mapInArrow(tidy(run), ", ".join(fields))
    return out.select(*df.columns) if redact else out


def masked(text: str | None, spans: list[tuple[int, int, int, bool]]) -> str | None:
    if not text or not spans:
        return text
    parts, at = [], 0
    for start, kind, end, _ in spans:
        if start >= at:
            parts += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*parts, text[at:]])


def _count(kind: str) -> F.Column:
    return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("bigint")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_pii(read_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    base = F.filter("spans", lambda s: s["base"])
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    counts = [_count(k).alias(f"n_{k}") for k in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("bigint").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: personal data in the text is replaced by its kind; n_chars follows the new text."""
    made = find_pii(docs, redact=True)
    if "n_chars" not in docs.columns:
        return made
    size = F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType)
    return made.withColumn("n_chars", size).select(*docs.columns)
