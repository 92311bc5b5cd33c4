"""Server names from the first packets of QUIC connections, with Spark's own AES and SHA-256.

An initial packet is protected by keys that follow from the connection id it shows: HKDF derives them, AES in ECB mode
gives the mask of its header, and AES-GCM opens it with the unmasked header as associated data. Its CRYPTO frames,
of one packet or of several, are pieces of the TLS hello, put together by their offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import let
from ..session import written
from .sniff import tls_name

# Fixed values of the protocol: version, salt of its initial secrets, prefix of its labels, type of initial packets.
VERSIONS = {
    0x00000001: ("38762cf7f55934b34d179ae6a4c80cadccbb7f0a", "quic", 0),
    0x6B3343CF: ("0dede3def700a6db819381be6e269dcbf9bd2ed9", "quicv2", 1),
    0xFF00001D: ("afbfec289993d24c9e9786f19c6111e04390a899", "quic", 0),
}
PADDING, PING, ACK, ACK_ECN, CRYPTO, CLOSE = 0, 1, 2, 3, 6, 0x1C
FRAGMENTS = "array<struct<at:bigint,data:binary>>"


def _number(hexadecimal: Column) -> Column:
    return F.conv(hexadecimal, 16, 10).cast("long")


def _byte(p: Column, i: Column) -> Column:
    return F.when((i >= 0) & (F.octet_length(p) > i), _number(F.hex(F.substring(p, i + 1, F.lit(1)))).cast("int"))


def _cut(p: Column, start: Column, n: Column) -> Column:
    """n bytes from an offset, null if there are fewer."""
    return F.when((start >= 0) & (n >= 0) & (F.octet_length(p) >= start + n), F.substring(p, start.cast("int") + 1, n.cast("int")))


def _varint(p: Column, i: Column) -> Column:
    """value and next: a number of 1, 2, 4 or 8 bytes, of which the first two bits tell the length."""
    return let(_byte(p, i), lambda b: let(F.pow(F.lit(2.0), F.shiftright(b, 6)).cast("int"), lambda n: F.struct(
        (F.coalesce(_number(F.hex(_cut(p, i + 1, n - 1))), F.when(n == 1, F.lit(0).cast("long"))) + b.bitwiseAND(F.lit(63)).cast("long") * F.pow(F.lit(256.0), n - 1).cast("long")).alias("value"), (i + n).alias("next"))))


def _padded(key: Column, pad: int) -> Column:
    """A key of 32 bytes, in hexadecimal, with the pad in every byte, and the pad up to 64 bytes."""
    word = int(f"{pad:02x}" * 4, 16)
    parts = [F.lpad(F.hex(_number(F.substring(key, 8 * k + 1, 8)).bitwiseXOR(F.lit(word))), 8, "0") for k in range(8)]
    return F.concat(*parts, F.lit(f"{pad:02x}" * 32))


def _hmac(inner: Column, outer: Column, message: Column) -> Column:
    """HMAC-SHA256 in hexadecimal, from the padded keys."""
    return F.sha2(F.unhex(F.concat(outer, F.sha2(F.unhex(F.concat(inner, message)), 256))), 256)


def extracted(salt: str, secret: Column) -> Column:
    """HKDF-Extract: the salt and the secret in hexadecimal."""
    key = bytes.fromhex(salt).ljust(64, b"\x00")
    inner, outer = (bytes(x ^ pad for x in key).hex() for pad in (0x36, 0x5C))
    return _hmac(F.lit(inner), F.lit(outer), secret)


def expanded(secret: Column, label: str, n: int) -> Column:
    """HKDF-Expand-Label of up to 32 bytes, in hexadecimal."""
    name = b"tls13 " + label.encode()
    info = n.to_bytes(2, "big") + bytes([len(name)]) + name + b"\x00\x01"
    return F.substring(_hmac(_padded(secret, 0x36), _padded(secret, 0x5C), F.lit(info.hex())), 1, 2 * n)


def with_keys(df: DataFrame, version: str, connection: str) -> DataFrame:
    """df with key, iv and hp (hexadecimal) of the client's initial packets to a connection id; null for other versions."""

    def chosen(of) -> Column:
        return F.coalesce(*[F.when(F.col(version) == v, of(salt, prefix)) for v, (salt, prefix, _) in VERSIONS.items()])

    d = df.withColumn("_initial", chosen(lambda salt, _: extracted(salt, F.hex(connection))))
    d = d.withColumn("_client", expanded(F.col("_initial"), "client in", 32))
    return d.withColumns({c: chosen(lambda _, prefix, c=c, n=n: expanded(F.col("_client"), f"{prefix} {c}", n)) for c, n in (("key", 16), ("iv", 12), ("hp", 16))}).drop("_initial", "_client")


def nonce(iv: Column, number: Column) -> Column:
    return F.unhex(F.concat(F.substring(iv, 1, 16), F.lpad(F.hex(_number(F.substring(iv, 17, 8)).bitwiseXOR(number)), 8, "0")))


def mask(hp: Column, sample: Column) -> Column:
    """Five bytes in hexadecimal."""
    return F.substring(F.hex(F.aes_encrypt(sample, F.unhex(hp), F.lit("ECB"), F.lit("PKCS"))), 1, 10)


def opened(df: DataFrame, payload: str = "payload") -> DataFrame:
    """df with plain: the frames of a client's initial packet, null for any other packet."""
    p, at = F.col(payload), F.col
    d = df.withColumns({"_first": _byte(p, F.lit(0)), "_version": _number(F.hex(_cut(p, F.lit(1), F.lit(4)))), "_dlen": _byte(p, F.lit(5))})
    kind = F.shiftright("_first", 4).bitwiseAND(F.lit(3))
    initial = F.coalesce(*[F.when(at("_version") == v, kind == t) for v, (_, _, t) in VERSIONS.items()], F.lit(False)) & (at("_first").bitwiseAND(F.lit(0xC0)) == 0xC0) & at("_dlen").between(1, 20)
    d = d.withColumn("_version", F.when(initial, at("_version")))
    d = d.withColumn("_dcid", F.when(at("_version").isNotNull(), _cut(p, F.lit(6), at("_dlen")))).withColumn("_slen", _byte(p, at("_dlen") + 6))
    d = d.withColumn("_token", F.when(at("_dcid").isNotNull(), _varint(p, at("_dlen") + 7 + at("_slen"))))
    d = d.withColumn("_size", F.when(at("_token.value") <= F.octet_length(p), _varint(p, (at("_token.next") + at("_token.value")).cast("int"))))
    d = d.withColumn("_head", F.when(at("_size.value") <= F.octet_length(p) - at("_size.next"), at("_size.next")))
    d = with_keys(d, "_version", "_dcid").withColumn("_mask", mask(at("hp"), _cut(p, at("_head") + 4, F.lit(16))))
    d = d.withColumn("_first", at("_first").bitwiseXOR(_number(F.substring("_mask", 1, 2)).cast("int").bitwiseAND(F.lit(15))))
    d = d.withColumn("_n", at("_first").bitwiseAND(F.lit(3)) + 1)
    unmasked = _number(F.hex(_cut(p, at("_head"), at("_n")))).bitwiseXOR(_number(F.substring(F.col("_mask"), F.lit(3), 2 * at("_n"))))
    d = d.withColumn("_number", unmasked)
    header = F.unhex(F.concat(F.lpad(F.hex("_first"), 2, "0"), F.hex(_cut(p, F.lit(1), at("_head") - 1)), F.lpad(F.hex("_number"), 8, "0").substr(9 - 2 * at("_n"), 2 * at("_n"))))
    data = _cut(p, at("_head") + at("_n"), at("_size.value") - at("_n"))
    plain = F.try_aes_decrypt(F.concat(nonce(at("iv"), at("_number")), data), F.unhex("key"), F.lit("GCM"), F.lit("DEFAULT"), header)
    return d.withColumn("plain", F.when(F.octet_length(data) > 16, plain)).select(*df.columns, "plain")


def _after(p: Column, at: Column, n: Column) -> Column:
    """Where n numbers from an offset end."""
    return F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n.cast("int")), at, lambda a, _: _varint(p, a)["next"])).otherwise(at)


def fragments(plain: Column) -> Column:
    """at and data of the CRYPTO frames of a packet; null where a frame is not of an initial packet or ends beyond it."""
    size, none = F.octet_length(plain), F.lit(-1)
    start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as {FRAGMENTS})").alias("found"))
    rest = lambda a: F.decode(F.substring(plain, a["at"] + 1, size), "ISO-8859-1")
    to = lambda a, at: F.struct(F.coalesce(F.when(at <= size, at), none).cast("int").alias("at"), a["found"].alias("found"))

    def crypto(a: Column) -> Column:
        return let(_varint(plain, a["at"] + 1), lambda off: let(_varint(plain, off["next"]), lambda n: let(_cut(plain, n["next"], n["value"]), lambda data: F.struct(
            F.when(data.isNotNull(), n["next"] + n["value"]).otherwise(none).cast("int").alias("at"),
            F.when(data.isNotNull(), F.concat(a["found"], F.array(F.struct(off["value"].alias("at"), data.alias("data"))))).otherwise(a["found"]).alias("found")))))

    def acknowledged(a: Column, more: Column) -> Column:
        return let(_varint(plain, _after(plain, a["at"] + 1, F.lit(2))), lambda ranges: to(a, F.when(ranges["value"] <= size, _after(plain, ranges["next"], 1 + 2 * ranges["value"] + more))))

    def step(a: Column, _) -> Column:
        blank = F.length(F.regexp_extract(rest(a), r"^[\x00\x01]+", 0))
        kind = _byte(plain, a["at"])
        close = let(_varint(plain, _after(plain, a["at"] + 1, F.lit(2))), lambda why: to(a, why["next"] + why["value"]))
        made = F.when(kind.isin(PADDING, PING), to(a, a["at"] + blank)).when(kind == CRYPTO, crypto(a)).when(kind == ACK, acknowledged(a, F.lit(0))).when(kind == ACK_ECN, acknowledged(a, F.lit(3))).when(kind == CLOSE, close)
        return F.when((a["at"] < 0) | (a["at"] >= size), a).otherwise(F.coalesce(made, to(a, none)))

    # Blank bytes are passed in one step and other frames have two bytes or more.
    ended = F.aggregate(F.sequence(F.lit(0), F.floor(size / 2).cast("int") + 2), start, step)
    return F.when(ended["at"] >= 0, ended["found"])


def put_together(found: Column) -> Column:
    """The bytes from offset 0 on, as far as there is no gap."""
    return F.aggregate(F.array_sort(found), F.lit(b""), lambda a, x: F.when(x["at"] == F.octet_length(a), F.concat(a, x["data"])).otherwise(a))


def hellos(packets: DataFrame, key: str = "connection", order: str = "seq", payload: str = "payload", most: int = 16) -> DataFrame:
    """key, protocol, domain and need_more for each connection, from its first `most` packets; `order` counts a connection's packets.

    protocol is quic once a packet could be opened; domain is the name in the hello, null as long as pieces of it are missing
    (need_more). Packets may repeat and come in any order. Only `most` packets of a connection are gathered, as a live
    classifier waits for no more. The client's make is not guessed.
    """
    some = packets.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("_from"))  # partial; then at most `most` orders from it
    near = packets.join(some, key).where(F.col(order) < F.col("_from") + most)
    # `most` packets a connection, or those of them that were sent again.
    # Written, so that conditions on what follows are not put in terms of the packets again.
    made = written(opened(near.select(key, payload).distinct(), payload).select(key, "plain"), "quic-opened").where("plain is not null")
    whole = made.withColumn("_found", fragments(F.col("plain"))).groupBy(key).agg(F.flatten(F.collect_list("_found")).alias("_found"), F.count("_found").alias("_n"))
    whole = written(whole, "quic-fragments").where("_n > 0").withColumn("_hello", put_together(F.array_distinct("_found")))
    size = _number(F.hex(_cut(F.col("_hello"), F.lit(1), F.lit(3))))
    complete = F.coalesce((_byte(F.col("_hello"), F.lit(0)) == 1) & (F.octet_length("_hello") >= size + 4), F.lit(False))
    name = F.lower(tls_name(F.when(complete, F.col("_hello"))))
    told = whole.select(key, F.lit("quic").alias("protocol"), name.alias("domain"), (~complete).alias("need_more"))
    return some.select(key).join(told, key, "left").withColumn("need_more", F.coalesce("need_more", F.lit(False)))
