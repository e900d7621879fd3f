"""Reading JSON that a language model has written a little wrongly."""

from __future__ import annotations

import json
import re

PLAIN = {"true": True, "True": True, "false": False, "False": False, "null": None, "None": None}
QUOTES = {'"': '"', "'": "'", "“": "”", "‘": "’"}
NEXT_KEY = re.compile(r"\s*(?:[\"'“‘][^\"”\n]*[\"'”’]|[A-Za-z_$][\w$-]*)\s*:|\s*[}\]]|\s*$")


class Reader:
    """Reads one value; what is missing at the end of the text is taken as closed.

    Keys and texts may have other quotes or (keys) none, commas may be doubled, missing or trail, and
    a quote inside a text that nothing fit to follow a text comes behind belongs to the text.
    """

    def __init__(self, text: str):
        self.text, self.at = text, 0

    def skip(self, also: str = "") -> str:
        """The next character that counts ('' at the end)."""
        while self.at < len(self.text):
            c = self.text[self.at]
            if self.text.startswith(("//", "#"), self.at) and "," in also:
                end = self.text.find("\n", self.at)
                self.at = len(self.text) if end < 0 else end
            elif c.isspace() or c in also:
                self.at += 1
            else:
                return c
        return ""

    def value(self, inside: str) -> object:
        c = self.skip()
        if c == "{":
            return self.object()
        if c == "[":
            return self.array()
        if c in QUOTES and c:
            return self.string(QUOTES[c], inside)
        found = re.compile(r"[^,}\]\n]*" if inside else r".*", re.S).match(self.text, self.at).group()
        self.at += max(1, len(found))
        word = found.strip()
        if word in PLAIN:
            return PLAIN[word]
        try:
            return json.loads(word)
        except ValueError:
            return word

    def object(self) -> dict:
        self.at += 1
        out: dict[str, object] = {}
        while (c := self.skip(",")) not in ("}", ""):
            if c == "]":
                return out  # an object left open inside a list
            if c in QUOTES:
                key = self.string(QUOTES[c], "key")
            else:
                key = re.compile(r"[^:,}\]\n]*").match(self.text, self.at).group()
                self.at += max(1, len(key))
                key = key.strip()
            if self.skip() == ":":
                self.at += 1
                out[key] = None if self.skip() in ("", ",", "}") else self.value("{")
            elif self.skip():
                out[key] = None
        self.at += 1
        return out

    def array(self) -> list:
        self.at += 1
        out = []
        while (c := self.skip(",")) not in ("]", ""):
            if c == "}":
                return out  # a list left open inside an object
            out.append(self.value("["))
        self.at += 1
        return out

    def ends(self, inside: str) -> bool:
        """Whether a text that ends here is followed by what may follow it."""
        rest = self.text[self.at :].lstrip()
        if inside == "key":
            return rest.startswith(":") or not rest
        if rest.startswith(","):
            return inside != "{" or NEXT_KEY.match(rest, 1) is not None
        return not rest or rest[0] in "}]" or bool(inside == "{" and NEXT_KEY.match(self.text, self.at) and "\n" in self.text[self.at : len(self.text) - len(rest)])

    def string(self, close: str, inside: str) -> str:
        self.at += 1
        out = []
        while self.at < len(self.text):
            c = self.text[self.at]
            self.at += 1
            if c == "\\" and self.at < len(self.text):
                size = 5 if self.text[self.at] == "u" else 1
                out.append(escaped(self.text[self.at : self.at + size]))
                self.at += size
            elif c == close and self.ends(inside):
                break
            else:
                out.append(c)
        return re.sub("[\ud800-\udbff][\udc00-\udfff]", lambda m: m.group().encode("utf-16", "surrogatepass").decode("utf-16"), "".join(out))


def escaped(body: str) -> str:
    try:
        return json.loads(f'"\\{body}"')
    except ValueError:
        return body


def try_json(text: str | None) -> tuple[object, bool]:
    """The value and whether the text had to be mended; (None, False) if there is no object or list in it.

    Fences and words around the object or list are left out; values stay as they are.
    """
    if text is None:
        return None, False
    try:
        return json.loads(text), False
    except RecursionError:
        return None, False
    except ValueError:
        pass
    start = re.search(r"[{\[]", text)
    if not start:
        return None, False
    reader = Reader(text[start.start() :])
    try:
        return reader.value(""), True
    except RecursionError:
        return None, False
