"""Labelled findings to learn from where a corpus brings none: the contexts below, each with values of every form.

What a finding is follows from the context it was written in, not from any rule over its features: whoever writes `client_secret = "` means a secret, and
whoever writes `commit ` doesn't, whatever the value looks like. Values are made by hashing, so no real secret is among them.
"""

from __future__ import annotations

import base64
import hashlib
import zlib

from pyspark.sql import DataFrame, SparkSession

#: What stands before a value that is a secret: the context, and a path.
SECRET = [
    ('token = "', "src/app"), ("token: ", ""), ('api_key: "', "config"), ("API_KEY=", ".env"), ('apiKey: "', "web/app"), ('password = "', "deploy"), ("DB_PASSWORD=", ".env"), ("passwd=", ""), ("pwd: ", "notes"),
    ("secret: ", ""), ('client_secret = "', "src/app"), ("Authorization: Bearer ", "logs"), ("aws_secret_access_key = ", "home"), ("private_key = ", "keys"), ('"accessToken": "', "data"), ("auth_token=", "scripts"),
    ("&token=", "logs"), ("?api_key=", "logs"), ("the login signature=", ""), ('credentials = "', "config"), ("X-Api-Key: ", "http"), ('SESSION_SECRET = "', "src3"), ("his password: ", "mail"), ("access key = ", ""),
]
#: What stands before a value that is none.
HARMLESS = [
    ("commit ", "git"), ("sha256: ", ""), ('checksum = "', "dist"), ('md5 = "', ""), ("uuid=", "db"), ("see revision ", "notes"), ("integrity: sha512-", "web"), ('etag: "', "logs"), ("guid: ", "db"), ("build id ", "ci"),
    ('digest = "', "images"), ("fingerprint: ", "src3"), ("hash=", ""), ("version ", ""), ("image: ", "deploy"), ("object ", "git"), ("the word ", ""), ("order number ", "mail"), ("session id ", "logs"), ("request ", "logs"),
    ('example token = "', "web"), ('sample password: "', ""), ('dummy api_key="', "src/app"), ('placeholder secret = "', "config"), ('token = "', "tests/fixtures"), ("password: ", "docs/readme"), ("API_KEY=", "examples"), ('secret = "', "test/mock"),
    ("with the file ", ""), ("and then ", ""), ("in the ", ""), ("at https://a.example/", "web"), ("named ", "src3"), ("written by ", ""),
]
AROUND = ["the house by the river", "und der weg ist nicht weit", "la maison est grande", "el camino de la casa", "set up as follows;", "-", ""]


def values(seed: str) -> list[str]:
    """A value of each form: hexadecimal ones of three lengths, base64, upper case, short, dotted, and with dashes."""
    raw = hashlib.sha512(seed.encode()).digest()
    hexed, coded = raw.hex(), base64.b64encode(raw).decode()
    uuid = "-".join((hexed[:8], hexed[8:12], hexed[12:16], hexed[16:20], hexed[20:32]))
    return [hexed[:40], hexed[:64], hexed[:32].upper(), coded[:40], coded[:24].replace("/", "x").replace("+", "y"), hexed[-9:] + "Z", f"{coded[:20]}.{coded[20:44]}".replace("/", "_").replace("+", "-"), uuid]


def words(seed: str) -> list[str]:
    """Values that are words: a long one, and a name of several."""
    at = zlib.crc32(seed.encode())
    return [["internationalisation", "donaudampfschifffahrt", "anticonstitutionnellement", "desafortunadamente"][at % 4], ["release_notes_of_the_year", "getCustomerOrderHistory", "src/main/resources/index", "well-known-identifier"][at // 4 % 4]]


def held_out(context: str) -> bool:
    """A quarter of the contexts, for a test of what is learnt from the others."""
    return zlib.crc32(context.encode()) % 4 == 0


def findings(spark: SparkSession, held: bool | None = None) -> DataFrame:
    """(candidate, before, after, path, label): all findings, or those of contexts that are held out, or aren't."""
    rows = []
    for label, contexts in ((1, SECRET), (0, HARMLESS)):
        for context, path in contexts:
            if held is not None and held_out(context) != held:
                continue
            for k, around in enumerate(AROUND):
                seed = f"{label}{context}{path}{k}"
                for value in values(seed) + (words(seed) if not label else []):
                    quote = '"' if context.endswith('"') else ""
                    rows.append((value, f"{around} {context}", f"{quote} {around}", path, label))
    return spark.createDataFrame(rows, "candidate string, before string, after string, path string, label int")
