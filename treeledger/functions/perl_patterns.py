"""Perl-style patterns written as Java ones.

Only whether a pattern is found matters here, not what it captures, so ``\\K`` and the flag ``U`` (which swap what a match covers, not
whether there is one) can go, and a branch reset is a plain group.  What has no equivalent is refused by name.
"""

import re

# POSIX class names and what Java calls them.
POSIX_CLASSES = {
    "alnum": "Alnum", "alpha": "Alpha", "ascii": "ASCII", "blank": "Blank", "cntrl": "Cntrl", "digit": "Digit",
    "graph": "Graph", "lower": "Lower", "print": "Print", "punct": "Punct", "space": "Space", "upper": "Upper",
    "xdigit": "XDigit",
}
_QUANTIFIER = re.compile(r"\{(\d*)(,?)(\d*)\}")
_POSIX = re.compile(r"\[:(\^?)(\w+):\]")
_PROPERTY = re.compile(r"\\[pP]\{[^}]*\}|\\x\{[0-9a-fA-F]+\}")
_OCTAL = re.compile(r"\\o\{([0-7]+)\}")
_NAMED_GROUP = re.compile(r"\(\?(?:P?<|')([A-Za-z_]\w*)[>']")
_NAMED_BACK = re.compile(r"\\k(?:\{(\w+)\}|'(\w+)'|<(\w+)>)|\\g\{([A-Za-z_]\w*)\}|\(\?P=(\w+)\)")
_NUMBERED_BACK = re.compile(r"\\g\{?(-?\d+)\}?")
_FLAGS = re.compile(r"\(\?([a-zA-Z]*)(?:-([a-zA-Z]*))?([:)])")


class _Reader:
    def __init__(self, pattern: str):
        self.pattern, self.at, self.out = pattern, 0, []
        self.extended = self.reset = self.lazy = self.keeps = False
        self.numbered = False

    def refuse(self, what: str):
        raise ValueError(f"{what} in {self.pattern!r} has no equivalent here")

    def take(self, expression: re.Pattern):
        found = expression.match(self.pattern, self.at)
        if found:
            self.at = found.end()
        return found

    def read(self) -> str:
        while self.at < len(self.pattern):
            char = self.pattern[self.at]
            if char == "\\":
                self.out.append(self.escape(inside=False))
            elif char == "[":
                self.out.append(self.bracket())
            elif char == "(":
                self.out.append(self.group())
            elif char == "{":
                self.out.append(self.brace())
            elif char == "#" and self.extended:
                end = self.pattern.find("\n", self.at)
                self.at = len(self.pattern) if end < 0 else end + 1
            else:
                if char == "+" and self.out and self.out[-1][-1:] in ("+", "*", "?", "}"):
                    self.keeps = True  # possessive
                self.out.append(char)
                self.at += 1
        if self.reset and self.numbered:
            self.refuse("a number of a group beside (?|")
        if self.lazy and self.keeps:
            self.refuse("the flag U beside possessive or atomic parts")
        return "".join(self.out)

    def escape(self, inside: bool) -> str:
        rest = self.pattern[self.at :]
        if rest.startswith("\\Q"):
            end = rest.find("\\E")
            text = rest[2:] if end < 0 else rest[2:end]
            self.at += len(rest) if end < 0 else end + 2
            return "".join(re.sub(r"[^A-Za-z0-9_]", lambda m: "\\" + m.group() if m.group().isascii() else m.group(), text))
        if found := self.take(_OCTAL):
            return f"\\x{{{int(found.group(1), 8):x}}}"
        if not inside:
            if found := self.take(_NAMED_BACK):
                return f"\\k<{_name(next(filter(None, found.groups())))}>"
            if found := self.take(_NUMBERED_BACK):
                if found.group(1).startswith("-"):
                    self.refuse("a relative number of a group")
                self.numbered = True
                return f"(?:\\{found.group(1)})"
        if found := self.take(_PROPERTY):
            return found.group().replace("L&", "LC")
        letter = rest[1:2]
        if not letter:
            raise ValueError(f"a lone \\ at the end of {self.pattern!r}")
        self.at += 2
        if inside and letter == "b":
            return "\\x08"
        if not inside and letter in ("K", "N"):
            return "" if letter == "K" else "[^\\n]"
        if letter in ("C", "g", "k"):
            self.refuse(f"\\{letter}")
        if not inside and letter.isdigit() and letter != "0":
            self.numbered = True
        return "\\" + letter

    def bracket(self) -> str:
        """A class: POSIX names become Java's; brackets, blanks and && lose the meaning that only Java gives them."""
        begin, parts = self.at, ["["]
        if _POSIX.match(self.pattern, self.at):
            self.refuse("a POSIX class outside a class")
        self.at += 1
        if self.pattern.startswith("^", self.at):
            parts.append("^")
            self.at += 1
        first = True
        while True:
            if self.at >= len(self.pattern):
                raise ValueError(f"no end of the class at {begin} in {self.pattern!r}")
            char = self.pattern[self.at]
            if char == "]" and not first:
                self.at += 1
                return "".join([*parts, "]"])
            first = False
            if found := self.take(_POSIX):
                parts.append(self.posix(found))
            elif char == "\\":
                parts.append(self.escape(inside=True))
            else:
                parts.append("\\" + char if char in "[]&^#" or char.isspace() else char)
                self.at += 1

    def posix(self, found: re.Match) -> str:
        negated, name = found.groups()
        if name == "word":
            return "\\W" if negated else "\\w"
        if name not in POSIX_CLASSES:
            self.refuse(f"the class [:{name}:]")
        return f"\\{'P' if negated else 'p'}{{{POSIX_CLASSES[name]}}}"

    def group(self) -> str:
        rest = self.pattern[self.at :]
        if rest.startswith("(*"):
            self.refuse("a verb")
        if rest.startswith("(?#"):
            end = rest.find(")")
            if end < 0:
                raise ValueError(f"no end of the comment in {self.pattern!r}")
            self.at += end + 1
            return ""
        if rest.startswith("(?|"):
            self.reset, self.at = True, self.at + 3
            return "(?:"
        if rest.startswith("(?P=") and (found := self.take(_NAMED_BACK)):
            return f"\\k<{_name(found.group(5))}>"
        if rest.startswith("(?>"):
            self.keeps = True
        if re.match(r"\(\?(?:R|[-+]?\d|&|P>|C|\()", rest):
            self.refuse("a recursion, condition or callout")
        if not rest.startswith(("(?<=", "(?<!")) and (found := self.take(_NAMED_GROUP)):
            return f"(?<{_name(found.group(1))}>"
        if found := self.take(_FLAGS):
            on, off, end = found.group(1), found.group(2) or "", found.group(3)
            if "U" in on:
                self.lazy = True
            if set(on + off) - set("imsxnU"):
                self.refuse(f"the flag {''.join(sorted(set(on + off) - set('imsxnU')))}")
            self.extended = ("x" in on) or (self.extended and "x" not in off)
            on, off = ("".join(c for c in flags if c in "imsx") for flags in (on, off))
            flags = f"(?{on}{'-' + off if off else ''}{end}"
            return "" if flags == "(?)" else flags
        self.at += 1
        return "("

    def brace(self) -> str:
        found = self.take(_QUANTIFIER)
        if found and (found.group(1) or (found.group(2) and found.group(3))):
            return f"{{{found.group(1) or '0'}{found.group(2)}{found.group(3)}}}"
        if found:
            self.at = found.start()
        self.at += 1
        return "\\{"


def _name(name: str) -> str:
    """Java's group names have letters and digits only."""
    return "g" + "".join(c if c.isalnum() else f"x{ord(c):x}x" for c in name)


def java_pattern(pattern: str) -> str:
    """The pattern in Java's syntax; ValueError for what that cannot say."""
    return _Reader(pattern).read()
