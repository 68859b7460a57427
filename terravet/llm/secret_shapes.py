"""Drawn examples for the secret scan: random keys, and harmless strings that look like keys.

The base patterns label few shapes of keys and hardly any harmless shape; these rules draw
the shapes that they leave out.  ``left`` is what stands before the candidate.
"""

from __future__ import annotations

import numpy as np

# Alphabets of keys, common prefixes of keys, and parts of harmless strings.
LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ALPHABETS = (LOWER + UPPER + DIGITS, LOWER + UPPER + DIGITS + "+/", LOWER + UPPER + DIGITS + "-_", LOWER + DIGITS,
             UPPER + DIGITS, UPPER + "234567", "ABCDEF" + DIGITS)
PREFIXES = ("sk-", "sk_live_", "pk_test_", "ghp_", "gho_", "glpat-", "xoxb-", "hf_", "AIza", "npm_", "rk_", "key-")
ONSETS = ("b", "br", "c", "ch", "d", "f", "g", "gr", "h", "j", "k", "l", "m", "n", "p", "pr", "qu", "r", "s", "sch", "st", "t", "th", "tr", "v", "w", "y", "z", "")
VOWELS = ("a", "e", "i", "o", "u", "ai", "ea", "ie", "ou", "eu", "io")
CODAS = ("", "", "n", "r", "s", "t", "l", "m", "nd", "nt", "st", "ng", "ck", "ss", "x", "rt")
HOSTS = ("com", "org", "net", "de", "fr", "io", "co.uk", "edu")
FOLDERS = ("usr", "local", "lib", "src", "main", "var", "log", "etc", "home", "opt", "bin", "share", "data", "test", "docs", "python3.11", "site-packages")
SUFFIXES = ("py", "txt", "html", "jpg", "png", "pdf", "csv", "json", "tar.gz", "js", "php", "md", "log")
WORDS = ("the", "of", "and", "for", "get", "set", "user", "value", "index", "report", "final", "test", "data", "file", "page", "name", "list", "news", "world")

#: Kinds of harmless strings; words in one piece are the hardest and are drawn twice as often.
HARMLESS = ("url", "path", "uuid", "date", "number", "slug", "name", "file", "word", "word")
#: Kinds that are also shown in capitals.
CASED = ("slug", "name", "file", "word")


class Shapes:
    def __init__(self, rng: np.random.Generator, words: list[str] = ()):
        self.rng, self.words = rng, [w for w in words if 2 < len(w) < 15 and w.isascii() and w.isalpha()]

    def pick(self, values):
        return values[int(self.rng.integers(len(values)))]

    def chars(self, alphabet: str, size: int) -> str:
        return "".join(alphabet[i] for i in self.rng.integers(len(alphabet), size=size))

    def word(self) -> str:
        kind = self.rng.random()
        if kind < 0.3:
            return self.pick(WORDS)
        if kind < 0.6 and self.words:
            return self.pick(self.words)
        return "".join(self.pick(ONSETS) + self.pick(VOWELS) + self.pick(CODAS) for _ in range(int(self.rng.integers(1, 4)))) or "a"

    def joined(self, by: str, least: int, most: int) -> str:
        return by.join(self.word().lower() for _ in range(int(self.rng.integers(least, most + 1))))

    def key(self, size: int) -> str:
        """A random key of ``size`` characters, now and then with a prefix or padding."""
        body = self.chars(self.pick(ALPHABETS), size)
        kind = self.rng.random()
        if kind < 0.12 and size >= 20:
            prefix = self.pick(PREFIXES)
            return prefix + body[len(prefix):]
        return body[:-1] + "=" if kind > 0.94 else body

    def digits(self, size: int) -> str:
        return self.chars(DIGITS, size)

    def day(self) -> str:
        return f"{self.rng.integers(1950, 2035)}-{self.rng.integers(1, 13):02d}-{self.rng.integers(1, 29):02d}"

    def harmless(self, kind: str) -> tuple[str, str]:
        """(left, candidate) of a kind of ``HARMLESS``; the candidate may be cut off at characters outside of runs."""
        rng = self.rng
        if kind == "url":
            sub = self.pick(("", "www.", "m.", self.word().lower() + ".", "blog.", "api."))
            host = f"{sub}{self.joined(self.pick(('', '-', '')), 1, 2)}.{self.pick(HOSTS)}"
            parts = [self.pick((self.word().lower(), self.joined("-", 2, 6), self.digits(int(rng.integers(1, 7))), self.day().replace("-", "/")))
                     for _ in range(int(rng.integers(0, 4)))]
            tail = "/".join(["", *parts]) + self.pick(("", "/", "." + self.pick(SUFFIXES), ""))
            return (self.pick(("http:", "https:")), "//" + host + tail) if rng.random() < 0.8 else ("", host + tail)
        if kind == "path":
            parts = [self.pick((self.pick(FOLDERS), self.word().lower(), self.word(), self.joined("_", 2, 3))) for _ in range(int(rng.integers(2, 7)))]
            return "", self.pick(("/", "./", "../", "")) + "/".join(parts) + self.pick(("", "/", "." + self.pick(SUFFIXES)))
        if kind == "uuid":
            made = "-".join(self.chars("abcdef" + DIGITS, n) for n in (8, 4, 4, 4, 12))
            return self.pick(("", "urn:uuid:", "id=")), made.upper() if rng.random() < 0.25 else made
        if kind == "date":
            clock = f"{rng.integers(0, 24):02d}"
            return "", self.pick((f"{self.day()}T{clock}", f"{self.day()}/{self.day()}", self.day().replace("-", "") + "-" + self.digits(6),
                                  self.day().replace("-", "") + "T" + self.digits(6) + "Z", self.day() + "-" + clock + "-" + self.digits(2), self.day() + "." + self.digits(6)))
        if kind == "number":
            if rng.random() < 0.4:
                return self.pick(("", "", "+", "No. ", "tel:", "#")), self.digits(int(rng.integers(12, 16)))
            return self.pick(("", "+", "No. ", "tel:")), self.pick(( ".".join(self.digits(3) for _ in range(int(rng.integers(3, 6)))),
                "-".join(self.digits(int(rng.integers(2, 5))) for _ in range(4)), f"{self.digits(6)}.{self.digits(8)}", "/".join(self.digits(4) for _ in range(3)),
                "+" + self.digits(2) + "-" + self.digits(3) + "-" + self.digits(7), self.pick(("DE", "FR", "GB")) + self.digits(13)))
        if kind == "slug":
            made = self.joined(self.pick("-_-"), 2, 7)
            return "", (made.upper() if rng.random() < 0.15 else made) + self.pick(("", "", "-" + self.digits(int(rng.integers(1, 5)))))
        if kind == "name":
            parts = [self.word().capitalize() for _ in range(int(rng.integers(2, 6)))]
            return "", self.pick(("".join(parts), parts[0].lower() + "".join(parts[1:]), "_".join(parts).upper(), ".".join(parts).lower(), "-".join(parts)))
        if kind == "file":
            return "", self.joined(self.pick("_-."), 1, 4) + self.pick(("", self.digits(4), "_v" + self.digits(1), "-" + self.day())) + "." + self.pick(SUFFIXES)
        long = "".join(self.word() for _ in range(int(rng.integers(2, 7))))
        return "", self.pick((long, long.lower(), long.upper(), long.upper(), long.capitalize())) + self.pick(("", ".", "-", "--", "...", "/"))
