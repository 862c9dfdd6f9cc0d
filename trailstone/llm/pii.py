"""Format-preserving pseudonyms for personal data.

Values are found by shape and accepted only when they validate (Luhn, mod 97, calendar, octets, number-plan rules). The
digits or letters that carry the value are numbered within their format and that number goes through a keyed Feistel
network, walking on until it falls inside the format again. So a pseudonym has the format of what it stands for and
validates too, equal values get equal pseudonyms in all documents whatever their separators, and the key's owner can
invert the text. Work is local to a row: no shuffle, and the key is all that is sent.

Kinds: card, phone, ssn, iban, ipv4, ipv6 (all eight groups written), email (local part), date, secret (values of
password/token/key assignments, access-key ids, signed web tokens and the bodies of private keys). Key names are in any case, quoted or not, and may end a longer name (db_password, authToken). Phones
written +1 (NNN) NNN-NNNN count also where the plan has no such area or exchange; their pseudonyms are such numbers too.
Cards are found with other
numbers before or behind them (expiry, CVV); where a pseudonym would make such a neighbour part of a card it is walked
on, the one case in which equal cards can get different pseudonyms. Where candidates overlap the earlier wins, then the longer.

Defined cases: null and empty texts come back empty with no spans; text without accepted values comes back as it was;
repeated rows come back alike; other columns of the input don't matter; an empty table gives no rows.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator
from datetime import date
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import pick, text_blocks

ROUNDS = 8
_FIRST_DAY, _DAYS = date(1900, 1, 1).toordinal(), date(2100, 1, 1).toordinal() - date(1900, 1, 1).toordinal()


#: Shapes of the kinds; a group named value holds the value, else the whole match does. Most begin with a set of few
#: characters, so that the bulk of a text is passed over quickly.
_SHAPES = [
    ("date", re.compile(r"[0-9]{2}(?<![\w/.-][0-9]{2})(?:[0-9]{2}([-/.])(?:0[1-9]|1[0-2])\1(?:0[1-9]|[12][0-9]|3[01])|([-/.])[0-3][0-9]\2(?:19|20)[0-9]{2})(?![\w]|[-/.][0-9])")),
    ("phone", re.compile(r"[+(2-9](?<![\w.][+(2-9])(?:(?<=[+])1[ .-]?(?:\([2-9][0-9]{2}\)|[2-9][0-9]{2})[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}|(?<=[+])1[ .-]?\([0-9]{3}\)[ .-]?[0-9]{3}[ .-]?[0-9]{4}|(?<=[(])[2-9][0-9]{2}\)[ .-]?[2-9][0-9]{2}[ .-]?[0-9]{4}|(?<=[2-9])[0-9]{2}(?P<gap>[ .-])[2-9][0-9]{2}(?P=gap)[0-9]{4}|(?<=[+])[2-9][0-9]{0,2}(?:[ .-]?[0-9]){6,13})(?!\w)")),
    ("ssn", re.compile(r"[0-9]{3}(?<![\w.-][0-9]{3})-[0-9]{2}-[0-9]{4}(?![\w-])")),
    ("iban", re.compile(r"[A-Z]{2}(?<!\w[A-Z]{2})[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)")),
    ("ipv4", re.compile(r"(?<![\w.-])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w-]|\.[0-9])")),
    ("iban", re.compile(r"[a-z]{2}(?<!\w[a-z]{2})[0-9]{2}(?: ?[a-z0-9]{4}){2,7}(?: ?[a-z0-9]{1,3})?(?!\w)")),
    ("email", re.compile(r"[^\W_](?<![\w.+%-].)[\w.%+-]{0,63}@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,24}(?![\w-])")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9a-f]{3,4}(?::[0-9a-f]{1,4}){0,6}::(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){0,6})?|[0-9A-F]{3,4}(?::[0-9A-F]{1,4}){0,6}::(?:[0-9A-F]{1,4}(?::[0-9A-F]{1,4}){0,6})?)(?![\w:]|[.][0-9])")),
    ("ipv6", re.compile(r"(?<![\w:.])(?:[0-9a-f]{1,4}(?::[0-9a-f]{1,4}){7}|[0-9A-F]{1,4}(?::[0-9A-F]{1,4}){7})(?![\w:]|[.][0-9])")),
    ("secret", re.compile(r"eyJ(?<!\weyJ)[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?![\w-])")),
    ("secret", re.compile(r"-----BEGIN (?:[A-Z]+ )?PRIVATE KEY-----\s+(?P<value>[A-Za-z0-9+/=\s]{32,}?)\s+-----END ")),
    ("secret", re.compile(r"AKIA(?<!\wAKIA)[0-9A-Z]{16}(?!\w)")),
    ("secret", re.compile(r"[pstkaPSTKA](?:(?<![^\W_].)|(?<=[a-z][PSTKA]))(?i:assword|asswd|ecret|ecret[_-]?key|oken|pi[_-]?key|ccess[_-]?key|ey)(?:\\?[\"'])?\s*[=:]\s*(?:\\?[\"'])?(?P<value>[A-Za-z0-9][A-Za-z0-9_+/.-]{6,})")),
    ("secret", re.compile(r"(?<=[pP])(?i:assword|asswd|assphrase|wd)(?:\\?[\"'])?\s*[=:]\s*(?:\\?[\"'])?(?P<value>(?=[^\s\"'<>]*[0-9!#$%&*?@^~])[^\s\"'<>\\]{4,128})")),
    ("secret", re.compile(r"(?<![A-Za-z0-9_])(?:gh[pousr]_|github_pat_|[sr]k_(?:live|test)_|xox[abprs]-|glpat-|AIza)(?P<value>(?=[A-Za-z_-]*[0-9])[A-Za-z0-9_-]{16,255})(?![A-Za-z0-9_-])")),
    ("secret", re.compile(r"(?i:authorization)(?:\\?[\"'])?\s*[:=]\s*(?:\\?[\"'])?(?i:bearer|basic|token)\s+(?P<value>[A-Za-z0-9+/=._~-]{4,})")),
    ("secret", re.compile(r"(?i:bearer)\s+(?P<value>(?=[A-Za-z+/=._~-]*[0-9])[A-Za-z0-9+/=._~-]{16,})")),
]
#: Runs of digit groups a space or dash apart, and the candidates that follow each other in them whatever their grouping.
_RUN = re.compile(r"[0-9](?<![\w.+][0-9])(?:[ -]?[0-9]){12,}(?![\w]|[.][0-9])")
_CHUNK = re.compile(r"[0-9](?<![\w.+][0-9])(?:[ -]?[0-9]){12,18}(?![\w]|[.][0-9])")
#: Lengths of the groups that cards are written in; such candidates are tried at every group, with a first digit of 2 to 6.
_GROUPED = re.compile(r"1[3-9]|4 4 4 4(?: [1-3])?|4 4 4 1|4 6 [45]|6 (?:[7-9]|1[0-3])")


class Feistel:
    """A keyed permutation of 0..size-1 for any size, one for each tweak."""

    def __init__(self, key: bytes):
        self.key = key

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        size = (bits + 7) // 8
        out, n = b"", 0
        while len(out) < size:
            out += blake2b(half.to_bytes(size, "big") + bytes([i, n]), key=self.key, person=tweak[:16].ljust(16, b"\0")).digest()
            n += 1
        return int.from_bytes(out[:size], "big") & ((1 << bits) - 1)

    def permute(self, x: int, size: int, tweak: bytes, back: bool = False) -> int:
        if size < 2:
            return x
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        mask = (1 << bits) - 1
        while True:
            left, right = x >> bits, x & mask
            for i in reversed(range(ROUNDS)) if back else range(ROUNDS):
                if back:
                    left, right = right ^ self._round(tweak, i, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, i, right, bits)
            x = left << bits | right
            if x < size:
                return x


def luhn_digit(digits: str) -> str:
    """The check digit that belongs behind these digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return str(-total % 10)


def iban_digits(country: str, account: str) -> str:
    """The two check digits of an IBAN."""
    return f"{98 - int(''.join(str(int(c, 36)) for c in account + country + '00')) % 97:02d}"


def is_card(digits: str) -> bool:
    return 13 <= len(digits) <= 19 and digits[0] != "0" and luhn_digit(digits[:-1]) == digits[-1]


def _refill(shape: str, chars: str) -> str:
    """The digits (or letters) of `shape` replaced one by one, separators left."""
    it = iter(chars)
    return "".join(next(it) if c.isalnum() else c for c in shape)


class Pseudonymiser:
    """Finds the values of a text and swaps them for their pseudonyms, or back."""

    def __init__(self, key: bytes):
        self.feistel = Feistel(key)

    def _number(self, digits: str, tweak: str, back: bool) -> str:
        return f"{self.feistel.permute(int(digits), 10 ** len(digits), f'{tweak}{len(digits)}'.encode(), back):0{len(digits)}d}" if digits else ""

    def _classes(self, value: str, tweak: str, back: bool, hexadecimal: bool = False) -> str:
        """Digits stay digits and ASCII letters letters of their case; with `hexadecimal`, each stays a hex digit."""
        lower = value.lower()
        sets = ["0123456789abcdef" if hexadecimal else "0123456789" if "0" <= c <= "9" else "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "" for c in lower]
        x, size = 0, 1
        for c, s in zip(lower, sets, strict=True):
            if s:
                x, size = x * len(s) + s.index(c), size * len(s)
        shape = "".join(str(len(s)) if s else c for c, s in zip(lower, sets, strict=True))
        x = self.feistel.permute(x, size, blake2b((tweak + shape).encode(), digest_size=16).digest(), back)
        out = []
        for c, low, s in zip(reversed(value), reversed(lower), reversed(sets), strict=True):
            if s:
                x, k = divmod(x, len(s))
                low = s[k]
            out.append(low.upper() if c.isupper() else low)
        return "".join(reversed(out))

    # each takes what its pattern matched and gives the pseudonym, or None if the value doesn't validate

    def card(self, shown: str, back: bool) -> str | None:
        d = re.sub(r"\D", "", shown)
        if not is_card(d):
            return None
        head = d[0] + self._number(d[1:-1], "card" + d[0], back)  # the issuer's class stays
        return _refill(shown, head + luhn_digit(head))

    def cards(self, text: str, taken: list[tuple[int, int]], back: bool) -> Iterator[tuple[int, int, str, str]]:
        """Cards in runs of digits, also with other numbers next to them; groups in `taken` spans belong to no grouped one.

        The rank of a candidate comes from the run's shape. A pseudonym that makes another candidate validate and outrank
        its card would not be found again, so it is walked on.
        """
        for m in _RUN.finditer(text):
            groups = [g.span() for g in re.finditer("[0-9]+", text[m.start() : m.end()])]
            groups = [(a + m.start(), b + m.start()) for a, b in groups]
            shaped = []
            for i in range(len(groups)):
                lengths: list[int] = []
                for a, b in groups[i : i + 19]:
                    if sum(lengths) + b - a > 19 or any(a < y and x < b for x, y in taken):
                        break
                    lengths.append(b - a)
                    if _GROUPED.fullmatch(" ".join(map(str, lengths))):
                        shaped.append((groups[i][0], b))
            chunks = [c.span() for c in _CHUNK.finditer(text, m.start(), m.end())]
            # a chunk that holds all of each grouped candidate it touches comes first, one that cuts some comes last
            ranked = [((1, a - b, a), a, b, "23456") for a, b in shaped]
            for a, b in chunks:
                near = shaped[bisect_left(shaped, (a - 40,)) : bisect_left(shaped, (b,))]
                cuts = any(x < b and a < y and not (a <= x and y <= b) for x, y in near)
                ranked.append(((2 if cuts else 0, a - b, a), a, b, "123456789"))
            now = text[m.start() : m.end()]

            def valid(c: tuple, now: str, at: int = m.start()) -> bool:
                d = re.sub(r"\D", "", now[c[1] - at : c[2] - at])
                return d[0] in c[3] and is_card(d)

            picked: list[tuple[int, int, tuple]] = []
            for c in sorted(c for c in ranked if valid(c, now)):
                k = bisect_left(picked, (c[1],))
                if (k == 0 or picked[k - 1][1] <= c[1]) and (k == len(picked) or c[2] <= picked[k][0]):
                    picked.insert(k, (c[1], c[2], c[0]))
            ranked.sort(key=lambda c: c[1])
            starts = [c[1] for c in ranked]
            own = {(a, b) for a, b, _ in picked}
            for a, b, _ in reversed(picked) if back else picked:
                rivals = []  # candidates that touch this card and that no picked one of better rank touches
                for c in ranked[bisect_left(starts, a - 40) : bisect_left(starts, b)]:
                    if c[2] > a and (c[1], c[2]) not in own:
                        beside = picked[max(0, bisect_left(picked, (c[1],)) - 1) : bisect_left(picked, (c[2],))]
                        if not any(x < c[2] and c[1] < y and rank < c[0] for x, y, rank in beside):
                            rivals.append(c)
                while True:
                    now = now[: a - m.start()] + self.card(now[a - m.start() : b - m.start()], back) + now[b - m.start() :]
                    if not any(valid(c, now) for c in rivals):
                        break
            yield from ((a, b, "card", now[a - m.start() : b - m.start()]) for a, b, _ in picked)

    def phone(self, shown: str, back: bool) -> str | None:
        d = re.sub(r"\D", "", shown)
        if shown[0] == "+" and d[0] != "1":
            return _refill(shown, d[:2] + self._number(d[2:], "phone" + d[:2], back)) if 8 <= len(d) <= 15 and d[0] != "0" else None
        country, d = d[:-10], d[-10:]
        if len(d) != 10 or country not in ("", "1"):
            return None
        if d[0] < "2" or d[3] < "2":
            return _refill(shown, country + self._unassigned(d, back)) if shown[0] == "+" and "(" in shown else None
        x = ((int(d[0]) - 2) * 100 + int(d[1:3])) * 800 + (int(d[3]) - 2) * 100 + int(d[4:6])
        x = self.feistel.permute(x * 10_000 + int(d[6:]), 6_400_000_000, b"phone1", back)
        x, line = divmod(x, 10_000)
        area, exchange = divmod(x, 800)
        return _refill(shown, f"{country}{area + 200}{exchange + 200}{line:04d}")

    def _unassigned(self, d: str, back: bool) -> str:
        """Walks on within the ten digits that the number plan gives to nobody."""
        while True:
            d = self._number(d, "phone0", back)
            if d[0] < "2" or d[3] < "2":
                return d

    def ssn(self, shown: str, back: bool) -> str | None:
        area, group, serial = int(shown[:3]), int(shown[4:6]), int(shown[7:])
        if area in (0, 666) or area >= 900 or not group or not serial:
            return None
        x = ((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1
        x, serial = divmod(self.feistel.permute(x, 898 * 99 * 9999, b"ssn", back), 9999)
        area, group = divmod(x, 99)
        return f"{area + 1 + (area >= 665):03d}{shown[3]}{group + 1:02d}{shown[6]}{serial + 1:04d}"

    def iban(self, shown: str, back: bool) -> str | None:
        s = shown.replace(" ", "")
        if not 15 <= len(s) <= 34 or iban_digits(s[:2], s[4:]) != s[2:4]:
            return None
        account = self._classes(s[4:], "iban" + s[:2].upper(), back)
        return _refill(shown, s[:2] + iban_digits(s[:2], account) + account)

    def ipv4(self, shown: str, back: bool) -> str | None:
        parts = shown.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        x = self.feistel.permute(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, b"ipv4", back)
        return ".".join(map(str, x.to_bytes(4, "big")))

    def email(self, shown: str, back: bool) -> str | None:
        local, _, host = shown.rpartition("@")
        return f"{self._classes(local, 'email' + host.lower(), back)}@{host}"

    def date(self, shown: str, back: bool) -> str | None:
        parts = re.split(r"\D", shown)
        year_first = len(parts[0]) == 4
        y, m, d = (int(p) for p in (parts if year_first else reversed(parts)))
        day_first = True
        try:
            day = date(y, m, d)
        except ValueError:
            if year_first:
                return None
            day_first = False
            try:
                day = date(y, d, m)
            except ValueError:
                return None
        x = day.toordinal() - _FIRST_DAY
        if not 0 <= x < _DAYS:
            return None
        # days up to the 12th and later ones are permuted among themselves, in all formats alike: a date that can only be
        # read month first becomes such a date, and the same day gets the same pseudonym however it is written
        late = day.day > 12
        while True:
            x = self.feistel.permute(x, _DAYS, b"date", back)
            new = date.fromordinal(x + _FIRST_DAY)
            if (new.day > 12) == late:
                break
        if year_first:
            return f"{new.year}{shown[4]}{new.month:02d}{shown[7]}{new.day:02d}"
        first, second = (new.day, new.month) if day_first else (new.month, new.day)
        return f"{first:02d}{shown[2]}{second:02d}{shown[5]}{new.year}"

    def ipv6(self, shown: str, back: bool) -> str | None:
        """The digits that are written; a shortened address keeps its shape, and isn't linked with its long form."""
        if "::" in shown and len(re.findall(r"[0-9A-Fa-f]+", shown)) > 7:
            return None
        return _refill(shown, self._hex(shown.replace(":", ""), back))

    def secret(self, shown: str, back: bool) -> str | None:
        if re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", shown) and len(shown) >= 16:
            return self._hex(shown, back)
        for head, known in (("AKIA", len(shown) == 20), ("eyJ", shown.count(".") == 2)):
            if known and shown.startswith(head):
                return head + self._classes(shown[len(head) :], "key", back)
        return self._classes(shown, "secret", back)

    def _hex(self, shown: str, back: bool) -> str:
        # hex digits of one case; a value of digits alone, or letters alone, is in both cases' format
        out = self._classes(shown.lower(), "hex", back, hexadecimal=True)
        return out.upper() if shown != shown.lower() else out

    def spans(self, text: str, back: bool = False) -> list[tuple[int, int, str, str]]:
        """(start, end, kind, pseudonym) of all accepted values, apart and in order."""
        found = []
        for kind, pattern in _SHAPES:
            if kind == "email" and "@" not in text:
                continue
            for m in pattern.finditer(text):
                g = "value" if "value" in pattern.groupindex else 0
                new = getattr(self, kind)(m.group(g), back)
                if new is not None:
                    found.append((m.start(g), m.end(g), kind, new))
        found += self.cards(text, [x[:2] for x in found if x[2] in ("date", "ssn")], back)
        found.sort(key=lambda x: (x[0], -x[1]))
        apart, end = [], 0
        for x in found:
            if x[0] >= end:
                apart.append(x)
                end = x[1]
        return apart

    def apply(self, text: str, back: bool = False) -> tuple[str, list[tuple[int, int, str]]]:
        """The text with pseudonyms, and the spans (in the text given) that were replaced."""
        parts, at, spans = [], 0, self.spans(text, back)
        for start, end, _, new in spans:
            parts += [text[at:start], new]
            at = end
        return "".join([*parts, text[at:]]) if spans else text, [x[:3] for x in spans]


def pseudonymise(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text", back: bool = False) -> DataFrame:
    """doc_id, text with pseudonyms, n_found and spans (kind, begin, end in the given text); back=True inverts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonymiser(key)
        for block in text_blocks(batches):
            done = [p.apply(x, back) for x in block.column("text").to_pylist()]
            spans = [[{"kind": k, "begin": a, "end": b} for a, b, k in s] for _, s in done]
            yield pa.RecordBatch.from_arrays(
                [block.column("doc_id"), pa.array([x for x, _ in done], pa.string()), pa.array(map(len, spans), pa.int64()), pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32())])))],
                ["doc_id", "text", "n_found", "spans"],
            )

    rows = pick(docs, id_col, text_col)
    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, text string, n_found long, spans array<struct<kind:string,begin:int,end:int>>")
