"""Check characters and other tests of structured values, as Column expressions."""

from __future__ import annotations

from . import sql as F
from .sql import Expr as Column

# Public rules of the Italian tax code. Letters that stand for digits 0 to 9, and the
# weights of 0-9 then A-Z in odd places; digits weigh as letters of the same number.
OMOCODIA = "LMNPQRSTUV"
ODD = [1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 1, 0, 5, 7, 9, 13, 15, 17, 19, 21, 2, 4, 18, 20, 11, 3, 6, 8, 12, 14, 16, 10, 22, 25, 24, 23]
ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def tax_code_check(code: str) -> str:
    """The check character of the first fifteen (plain Python, to make valid values)."""
    total = 0
    for i, c in enumerate(code[:15]):
        n = ALPHABET.index(c)
        total += ODD[n] if i % 2 == 0 else n - 10 if n > 9 else n
    return chr(65 + total % 26)


def tax_code_ok(value: Column) -> Column:
    """The day is at most 71; and the value is upper case, unbroken and has a digit, or its check
    character is right."""
    code = F.upper(F.regexp_replace(value, " ", ""))
    day = F.translate(F.substring(code, 10, 2), OMOCODIA, "0123456789").try_cast("int")
    place = lambda i: F.instr(F.lit(ALPHABET), F.substring(code, i, 1))
    odd = F.array(*map(F.lit, ODD))
    total = F.aggregate(
        F.sequence(F.lit(1), F.lit(15)),
        F.lit(0),
        lambda a, i: a + F.when(i % 2 == 1, F.element_at(odd, F.greatest(place(i), F.lit(1)))).otherwise(F.when(place(i) > 10, place(i) - 11).otherwise(place(i) - 1)),
    )
    right = F.substring(code, 16, 1) == F.substring(F.lit(ALPHABET[10:]), total % 26 + 1, F.lit(1))
    return F.coalesce((day <= 71) & (((value == code) & code.rlike("[0-9]")) | right), F.lit(False))


def iban_remainder(value: Column) -> Column:
    code = F.regexp_replace(value, " ", "")
    turned = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, 1, 4))
    return F.aggregate(
        F.filter(F.split(turned, ""), lambda c: c != ""),
        F.lit(0),
        lambda a, c: (F.when(c.rlike("[0-9]"), a * 10 + F.coalesce(c.try_cast("int"), F.lit(0))).otherwise(a * 100 + F.ascii(c) - 55)) % 97,
    )


def iban_ok(value: Column) -> Column:
    """An Italian one without a space behind the country; any other by its remainder."""
    return value.rlike("^IT[0-9]") | (iban_remainder(value) == 1)


#: Mail domains of public administrations, and the words that a local one begins with.
OFFICES = "agenziaentrate.it avvocaturastato.it corteconti.it ga-cert.it giustizia-amministrativa.it giustizia.it giustiziacert.it gov.it inail.it inps.it".split()
LOCAL_OFFICES = ("comune", "provincia", "regione")


def public_mailbox(value: Column, first_names, offices: list[str] = OFFICES) -> Column:
    """An office's mailbox: a public body's domain and no first name in front of it."""
    domain = F.lower(F.substring_index(value, "@", -1))
    parts = F.split(domain, r"\.")
    last = lambda n: F.array_join(F.slice(parts, F.greatest(F.size(parts) - n + 1, F.lit(1)), F.lit(n)), ".")
    local = (F.element_at(parts, -1) == "it") & F.element_at(parts, -3).isin(*LOCAL_OFFICES)
    office = last(2).isin(*offices) | F.when(F.size(parts) >= 3, local).otherwise(False)
    tokens = F.transform(F.regexp_extract_all(F.substring_index(value, "@", 1), F.lit(r"(\p{L}+)"), F.lit(1)), lambda t: F.lower(t))
    return office & ~F.exists(tokens, lambda t: t.isin(*first_names))
