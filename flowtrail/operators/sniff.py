"""Protocol, domain and client of recorded payloads, as byte expressions.

Each classifier gives (ok, more): it is what it says, or more bytes are needed to tell. The first that
is ok wins, in the order of STREAM or PACKET.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.scalar import let

#: On these ports the server speaks first.
SERVER_FIRST = (25, 465, 587, 143, 993, 110, 995)


def _at(p: Column, i: int, n: int = 1) -> Column:
    """n bytes from offset i as an unsigned number; null beyond the end."""
    # A decimal takes several times as long as a long.
    return F.when(F.octet_length(p) >= i + n, F.conv(F.hex(F.substring(p, i + 1, n)), 16, 10).cast("long" if n < 8 else "decimal(20,0)"))


def _has(p: Column, text: str, at: int = 0) -> tuple[Column, Column]:
    """(the bytes at `at` are text, what there is agrees but is short)."""
    data = text.encode("latin-1")
    n = F.octet_length(p)
    here = F.hex(F.substring(p, at + 1, len(data)))
    full = F.lit(data.hex().upper())
    return (n >= at + len(data)) & (here == full), (n < at + len(data)) & F.startswith(full, here)


def ssh(p: Column):
    ok, more = _has(p, "SSH-2.0-")
    return ok, more


def ssh_client(p: Column) -> Column:
    """The rest of the first line."""
    return F.regexp_extract(F.decode(p, "ISO-8859-1"), r"^SSH-2\.0-([^\r\n]*)", 1)


def bittorrent(p: Column):
    return _has(p, "\x13BitTorrent protocol")


def rdp(p: Column):
    known = {0: 3, 1: 0, 2: 0, 3: 19, 4: 14, 5: 0xE0, 11: 1, 13: 8}
    ok, so_far = F.octet_length(p) >= 14, F.lit(True)
    for i, v in known.items():
        so_far = so_far & F.coalesce(_at(p, i) == v, F.lit(True))
    return ok & so_far, ~ok & so_far


def http(p: Column):
    """A request line and the Host header."""
    text = F.decode(p, "ISO-8859-1")
    return F.regexp(text, F.lit(r"^[A-Z]+ \S+ HTTP/1\.[01]\r?\n")) & F.regexp(text, F.lit(r"(?s)\r?\n\r?\n")), F.regexp(text, F.lit(r"^[A-Z]{1,10}( |\z)")) & ~F.contains(text, F.lit("\r\n\r\n"))


def http_host(p: Column) -> Column:
    return F.regexp_extract(F.decode(p, "ISO-8859-1"), r"(?i)\r?\nhost:[ \t]*(\[[^\]]*\]|[^:\r\n \t]*)", 1)


def tls(p: Column, records: Column | None = None):
    """Handshake records that hold a whole client hello between them; records: what handshake() makes of p."""
    records = handshake(p) if records is None else records
    body = records["body"]
    begun, whole = F.coalesce(_at(body, 0) == 1, F.octet_length(body) == 0), F.coalesce(F.octet_length(body) >= _at(body, 1, 3) + 4, F.lit(False))
    start = F.coalesce(_at(p, 0) == 22, F.lit(True)) & F.coalesce(_at(p, 1) == 3, F.lit(True))
    return F.coalesce(begun & whole, F.lit(False)), F.when(body.isNotNull(), begun & ~whole & ~records["ended"]).otherwise(start & (F.octet_length(p) < 2))


def handshake(p: Column) -> Column:
    """body: what the handshake records from the start on carry, the last one as far as it is there, null if there is none; ended: a record of another kind follows."""
    size, first = F.octet_length(p), _at(p, 3, 2).cast("int")
    start = F.struct(F.lit(0).alias("at"), F.lit(b"").alias("body"), F.lit(False).alias("ended"))

    def step(a: Column, _) -> Column:
        kind, n = _at_col(p, a["at"]), F.conv(F.hex(F.substring(p, a["at"] + 4, F.lit(2))), 16, 10).cast("int")
        return (
            F.when(a["ended"] | (a["at"] >= size), a).when(kind != 22, F.struct(a["at"].alias("at"), a["body"].alias("body"), F.lit(True).alias("ended")))
            .when(a["at"] + 5 > size, F.struct(size.alias("at"), a["body"].alias("body"), F.lit(False).alias("ended")))
            .otherwise(F.struct((a["at"] + 5 + n).alias("at"), F.concat(a["body"], F.substring(p, a["at"] + 6, n)).alias("body"), F.lit(False).alias("ended")))
        )

    # Nearly every hello is in one record.
    alone = (size <= 5 + first) | F.coalesce(_at(p, 6, 3) + 4 <= first, F.lit(False))
    one = F.struct(size.alias("at"), F.substring(p, F.lit(6), first).alias("body"), F.lit(False).alias("ended"))
    head = (_at(p, 0) == 22) & (_at(p, 1) == 3)
    return F.when(head & F.coalesce(alone, F.lit(False)), one).when(head, F.aggregate(F.sequence(F.lit(0), F.floor(size / 5).cast("int")), start, step))


def hello_name(hello: bytes) -> str | None:
    """The server name of a client hello: found by walking the hello's lengths to its extensions."""
    at = 38
    for size in (1, 2, 1):  # session, cipher suites, compression methods
        if at >= len(hello):
            return None
        at += size + int.from_bytes(hello[at : at + size], "big")
    end, at = at + 2 + int.from_bytes(hello[at : at + 2], "big"), at + 2
    while at + 4 <= min(end, len(hello)):
        if hello[at] == hello[at + 1] == 0:
            return hello[at + 9 : at + 9 + int.from_bytes(hello[at + 7 : at + 9], "big")].decode(errors="replace") if at + 7 < len(hello) else None
        at += 4 + int.from_bytes(hello[at + 2 : at + 4], "big")
    return None


@F.arrow_udf(T.StringType())
def tls_name(hellos: pa.Array) -> pa.Array:
    """hello_name() of each; a walk of as many steps as there are extensions."""
    return pa.array([None if x is None else hello_name(x) for x in hellos.to_pylist()], pa.string())


def dns_packet(p: Column):
    """A query: not a response, with a question, without answers or authorities."""
    n = F.octet_length(p)
    return (n >= 17) & (_at(p, 2).cast("int").bitwiseAND(F.lit(128)) == 0) & (_at(p, 4, 2) > 0) & (_at(p, 6, 4) == 0), F.lit(False)


def dns_stream(p: Column):
    body = F.substring(p, 3, 1 << 20)
    n, size = F.octet_length(p) - 2, _at(p, 0, 2)
    bad = (size < 12) | F.coalesce(_at(body, 2).cast("int").bitwiseAND(F.lit(128)) != 0, F.lit(False)) | F.coalesce(_at(body, 4, 2) == 0, F.lit(False))
    for i in range(6, 10):
        bad = bad | F.coalesce(_at(body, i) != 0, F.lit(False))
    short = size.isNull() | (n < size)
    return ~F.coalesce(bad, F.lit(False)) & ~short & dns_packet(body)[0], ~F.coalesce(bad, F.lit(False)) & short


def stun(p: Column):
    return (F.octet_length(p) >= 20) & (_at(p, 4, 4) == 0x2112A442) & (F.octet_length(p) >= _at(p, 2, 2) + 20), F.lit(False)


def utp(p: Column):
    """Version 1, a type up to 4, and extensions that end within the packet."""
    first = _at(p, 0).cast("int")
    b = lambda i: _at_col(p, i)
    # (next extension, offset): ends at extension 0; -1 where it breaks off.
    start = F.struct(_at(p, 1).cast("int").alias("ext"), F.lit(20).alias("at"))

    def step(a: Column, _) -> Column:
        nxt, size = b(a["at"]), b(a["at"] + 1)
        broken = nxt.isNull() | size.isNull() | (nxt > 4)
        return F.when(a["ext"] <= 0, a).when(F.coalesce(broken, F.lit(True)), F.struct(F.lit(-1).alias("ext"), a["at"].alias("at"))).otherwise(F.struct(nxt.alias("ext"), (a["at"] + 2 + size).alias("at")))

    ended = F.aggregate(F.sequence(F.lit(0), F.floor(F.octet_length(p) / 2).cast("int")), start, step)["ext"] == 0
    return (F.octet_length(p) >= 20) & (first.bitwiseAND(F.lit(15)) == 1) & (F.shiftright(first, 4) <= 4) & ended, F.lit(False)


def _at_col(p: Column, i: Column) -> Column:
    return F.when(F.octet_length(p) > i, F.conv(F.hex(F.substring(p, i + 1, F.lit(1))), 16, 10).cast("int"))


def udp_tracker(p: Column):
    """The connect request: fixed protocol id, action 0."""
    return (F.octet_length(p) >= 16) & (_at(p, 0, 8) == 0x41727101980) & (_at(p, 8, 4) == 0), F.lit(False)


def dtls(p: Column):
    return (F.octet_length(p) >= 13) & _at(p, 0).isin(20, 21, 22, 23, 25) & (_at(p, 1) == 0xFE) & _at(p, 2).isin(0xFF, 0xFD), F.lit(False)


def ntp(p: Column):
    """A client request of version 3 or 4 whose root delay and dispersion are at most 16 seconds."""
    first = _at(p, 0).cast("int")
    version = F.shiftright(first, 3).bitwiseAND(F.lit(7))
    return (F.octet_length(p) >= 48) & version.isin(3, 4) & (first.bitwiseAND(F.lit(7)) == 3) & (_at(p, 4, 4) <= 16 * 65536) & (_at(p, 8, 4) <= 16 * 65536), F.lit(False)


STREAM = {"tls": tls, "http": http, "dns": dns_stream, "bittorrent": bittorrent, "ssh": ssh, "rdp": rdp}
PACKET = {"dns": dns_packet, "stun": stun, "utp": utp, "udp_tracker": udp_tracker, "dtls": dtls, "ntp": ntp}
NAMED = {"utp": "bittorrent", "udp_tracker": "bittorrent"}


def told(p: Column, packet: bool = False) -> Column:
    """protocol, domain, client and need_more of a payload, and the hello of which the domain is still to be read (named)."""
    sure = lambda c: F.coalesce(c, F.lit(False))

    def made(records: Column | None) -> Column:
        protocol, more = None, F.lit(False)
        for name, test in (PACKET if packet else STREAM).items():
            ok, short = test(p, records) if name == "tls" else test(p)
            name = NAMED.get(name, name)
            protocol = F.when(sure(ok), name) if protocol is None else protocol.when(sure(ok), name)
            more = more | sure(short)
        # Packets have neither.
        domain = lambda x: F.lit(None).cast("string") if records is None else F.when(x == "http", F.lower(http_host(p)))
        hello = lambda x: F.lit(None).cast("binary") if records is None else F.when(x == "tls", records["body"])
        return let(protocol, lambda x: F.struct(
            x.alias("protocol"), domain(x).alias("domain"),
            F.when(x == "ssh", ssh_client(p)).alias("client"), (x.isNull() & more).alias("need_more"), hello(x).alias("hello")))

    return made(None) if packet else let(handshake(p), made)


def named(told: str) -> list[Column]:
    """protocol, domain and client of a column that told() made; names are read once a stream, however many pieces it was told from."""
    return [F.col(f"{told}.protocol"), F.coalesce(f"{told}.domain", F.lower(tls_name(F.col(f"{told}.hello")))).alias("domain"), F.col(f"{told}.client")]


def classify(df: DataFrame, payload: str = "payload", packet: bool = False, port: str | None = None) -> DataFrame:
    """Adds protocol, domain, client and need_more. Streams to server-first ports are not looked at."""
    what = told(F.col(payload), packet)
    if port and not packet:
        what = F.when(~F.coalesce(F.col(port).isin(*SERVER_FIRST), F.lit(False)), what)
    out = df.withColumn("_told", what)
    return out.select(*df.columns, *named("_told"), F.coalesce("_told.need_more", F.lit(False)).alias("need_more"))


#: Bytes of a connection after which no more is waited for.
LIMIT = 16_384


def classify_pieces(pieces: DataFrame, key: str, order: str, payload: str = "payload", port: str | None = None, limit: int = LIMIT) -> DataFrame:
    """key, protocol, domain, client, need_more and n_pieces (how many were read), for streams that come in pieces.

    `order` counts a connection's pieces from 0. They are put together one after the other, and what there is so far is
    classified, until it is decided or no classifier asks for more. Pieces that begin `limit` bytes or more into the stream
    are not read, so a connection has `limit` pieces at most whatever its length; empty ones are not counted.
    """
    some = pieces.where(F.col(key).isNotNull() & (F.col(order) < limit) & (F.octet_length(payload) > 0))
    before = F.coalesce(F.sum(F.octet_length(payload)).over(Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = F.first(port, ignorenulls=True) if port else F.lit(None).cast("int")
    joined = some.withColumn("_at", before).where(F.col("_at") < limit).groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, F.col(payload).alias("data")))).alias("_pieces"), first.alias("_port"))
    start = F.struct(F.lit(b"").alias("data"), F.lit(0).alias("n_pieces"), F.struct(F.lit(None).cast("string").alias("protocol"), F.lit(None).cast("string").alias("domain"), F.lit(None).cast("string").alias("client"), F.lit(True).alias("need_more"), F.lit(None).cast("binary").alias("hello")).alias("told"))

    def step(a: Column, x: Column) -> Column:
        return F.when(~a["told"]["need_more"], a).otherwise(let(F.concat(a["data"], x["data"]), lambda p: F.struct(p.alias("data"), (a["n_pieces"] + 1).alias("n_pieces"), told(p).alias("told"))))

    made = joined.withColumn("_made", F.when(~F.coalesce(F.col("_port").isin(*SERVER_FIRST), F.lit(False)), F.aggregate("_pieces", start, step)))
    return made.select(key, *named("_made.told"), F.coalesce("_made.told.need_more", F.lit(False)).alias("need_more"), F.coalesce("_made.n_pieces", F.lit(0)).alias("n_pieces"))


def ja3(hello: DataFrame, standard: bool = True) -> DataFrame:
    """Adds ja3 and ja3_md5 from version, ciphers, extensions, groups, formats (arrays of numbers).

    GREASE values (0x?A?A, both bytes alike in their low halves) are left out; with standard=False only
    they are kept, which is what the literal test of the survey does.
    """
    grease = lambda v: v.bitwiseAND(F.lit(0x0F0F)) == 0x0A0A
    keep = (lambda v: ~grease(v)) if standard else grease
    joined = lambda c, f=True: F.array_join(F.transform(F.filter(c, keep) if f else F.col(c), lambda v: v.cast("string")), "-")
    text = F.concat_ws(",", F.col("version").cast("string"), joined("ciphers"), joined("extensions"), joined("groups"), joined("formats", False))
    return hello.withColumn("ja3", text).withColumn("ja3_md5", F.md5(F.col("ja3").cast("binary")))
