"""Generated detection cases with known answers: 215 positives of all fourteen types and 100 negatives, all synthetic."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sluice.functions.patterns import BASE36, VERHOEFF_PERMUTATION, VERHOEFF_PRODUCT

_LETTERS = "ABCDEFGHJKLMNPQRSTUVWXYZ"
_NAMES = ("Asha Verma", "Rohan Mehta", "Leela Nair", "Imran Sheikh", "Tara Bose")


def _tag(i: int, n: int) -> str:
    """n letters that differ from i to i."""
    return "".join(_LETTERS[(i * 7 + j * 5 + i // (j + 1)) % len(_LETTERS)] for j in range(n))


def _card(i: int) -> str:
    """Sixteen digits with a Luhn check digit."""
    body = f"4{i:03d}0072{i * 37 % 10000:04d}519"
    total = sum((d * 2 - 9 if d * 2 > 9 else d * 2) if k % 2 == 0 else d for k, d in enumerate(map(int, reversed(body))))
    return body + str(-total % 10)


def _verhoeff(i: int) -> str:
    """Twelve digits with a Verhoeff check digit."""
    body, check = f"{2 + i % 8}{i * 7919 % 10**10:010d}", 0
    for k, d in enumerate(reversed(body)):
        check = VERHOEFF_PRODUCT[check][VERHOEFF_PERMUTATION[(k + 1) % 8][int(d)]]
    return body + str([row.index(0) for row in VERHOEFF_PRODUCT][check])


def _gstin(i: int) -> str:
    """Fifteen characters with a check character of base 36."""
    body, total = f"{10 + i:02d}{_tag(i, 5)}{3000 + i}{_tag(i, 1)}{1 + i % 9}Z", 0
    for k, ch in enumerate(body):
        product = BASE36.index(ch) * (k % 2 + 1)
        total += product // 36 + product % 36
    return body + BASE36[-total % 36]


#: type: (cases, critical, texts of case i in turn). Each type has its plain form and the punctuated ones.
POSITIVES = {
    "EMAIL": (25, False, (lambda i: f"Write to reader{i}@mail{i}.example for news", lambda i: f"Contact <first.last+{i}@sub.mail-{i}.org>.")),
    "PHONE": (25, False, (lambda i: f"Ring {7 + i % 3}{i:04d} {54321 - i} after nine", lambda i: f"Mobile: +91 {6 + i % 4}{i:04d}-{20000 + i}", lambda i: f"call +91-{70000 + i}{40000 + i}")),
    "PAN": (20, False, (lambda i: f"Tax card {_tag(i, 5)}{1000 + i}{_tag(i, 1)} was seen", lambda i: f"PAN {_tag(i, 5)}{i:04d}{_tag(i + 1, 1)}")),
    "IFSC": (15, False, (lambda i: f"Branch {_tag(i, 4)}0{200000 + i} is open", lambda i: f"IFSC {_tag(i, 4)}0{i:06d}")),
    "UPI_ID": (15, False, (lambda i: f"Pay to shop.{i}@okbank today", lambda i: f"UPI sender_{i}-x@bankax")),
    "OTP": (15, True, (lambda i: f"Your OTP is {4000 + 13 * i} now", lambda i: f"One-time password: {310000 + i}", lambda i: f"verification code - {8800 + i}")),
    "PASSWORD": (15, True, (lambda i: f"password: Qz{i}wv!x{i}", lambda i: f"password=Hidden{i}!", lambda i: f"pin = {7000 + i}")),
    "ACCOUNT_ID": (15, False, (lambda i: f"customer id: AB-{7000 + i}", lambda i: f"Customer ID: CU{i:05d}", lambda i: f"Employee no. EM-{90000 + i}")),
    "PERSON_NAME": (15, False, (lambda i: f"Name: {_NAMES[i % 5]}", lambda i: f"Patient: Exempla Human{_LETTERS[i]}")),
    "ADDRESS": (15, False, (lambda i: f"Address: {i + 3} Lake View Road, Block {_LETTERS[i]}", lambda i: f"residing at - {i + 1} Quiet Street, Sample Town")),
    "MEDICAL": (15, False, (lambda i: f"Diagnosis: mild seasonal allergy, stage {_LETTERS[i]}", lambda i: f"Patient history: steady-state-{i}")),
    "PAYMENT_CARD": (5, True, (lambda i: f"Charge {_card(i)} once", lambda i: f"Card: {' '.join(_card(i)[k : k + 4] for k in range(0, 16, 4))}", lambda i: f"Card {'-'.join(_card(i)[k : k + 4] for k in range(0, 16, 4))}")),
    "GSTIN": (10, False, (lambda i: f"Invoice of {_gstin(i)}.",)),
    "AADHAAR_LIKE": (10, True, (lambda i: f"Number {_verhoeff(i)} given", lambda i: f"id {_verhoeff(i)[:4]} {_verhoeff(i)[4:8]} {_verhoeff(i)[8:]}")),
}
NEGATIVES = (100, lambda i: (f"Plain row {i} lists {i % 9} green items and nothing else", f"Public item {i + 1} costs ₹{800 + i}; delivery in {2 + i % 5} days")[i % 2])


def rows() -> list[tuple[str, str, list[str], bool]]:
    found = [(f"{kind.lower()}-{i}", texts[i % len(texts)](i), [kind], critical) for kind, (n, critical, texts) in POSITIVES.items() for i in range(n)]
    return found + [(f"negative-{i}", NEGATIVES[1](i), [], False) for i in range(NEGATIVES[0])]


def cases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(rows(), "case_id string, text string, expected array<string>, critical boolean")
