"""FLAC streams against a plain scalar reader, and HTML extraction."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pytest
from helpers import clashing, frame, some_docs

from foliospark.llm import flac, html_text


class Bits:
    def __init__(self, data):
        self.data, self.at = data, 0

    def take(self, n):
        out = 0
        for _ in range(n):
            out = out << 1 | self.data[self.at >> 3] >> (7 - (self.at & 7)) & 1
            self.at += 1
        return out

    def signed(self, n):
        x = self.take(n)
        return x - (1 << n) if x >> (n - 1) else x


def crc(data, poly, bits):
    out = 0
    for b in data:
        out ^= b << (bits - 8)
        for _ in range(8):
            out = ((out << 1) ^ poly if out >> (bits - 1) & 1 else out << 1) & ((1 << bits) - 1)
    return out


def plain_reader(stream):
    """Samples by the format's description, bit by bit."""
    assert stream[:4] == b"fLaC"
    at, last = 4, False
    while not last:
        last, kind, size = stream[at] >> 7, stream[at] & 127, int.from_bytes(stream[at + 1 : at + 4], "big")
        body = stream[at + 4 : at + 4 + size]
        if kind == 0:
            total, md5 = int.from_bytes(body[10:18], "big") & (1 << 36) - 1, body[18:]
        at += 4 + size
    samples, number = [], 0
    while at < len(stream):
        b = Bits(stream[at:])
        assert b.take(14) == 0b11111111111110 and b.take(2) == 0 and b.take(4) == 2 and b.take(4) == 0 and b.take(4) == 0 and b.take(3) == 1 and b.take(1) == 0
        lead = b.take(8)
        n, more = (lead, 0) if lead < 128 else (lead & (1 << (6 - (ones := len(bin(lead)[2:].split("0")[0]) - 1))) - 1, ones)
        for _ in range(more):
            n = n << 6 | b.take(8) & 63
        assert n == number
        head = b.at // 8
        assert b.take(8) == crc(stream[at : at + head], 7, 8)
        assert b.take(1) == 0
        kind = b.take(6)
        assert b.take(1) == 0
        if kind == 0:
            x = [b.signed(8)] * 576
        elif kind == 1:
            x = [b.signed(8) for _ in range(576)]
        else:
            order = kind - 31 if kind >= 32 else kind - 8
            x = [b.signed(8) for _ in range(order)]
            if kind >= 32:
                width = b.take(4) + 1
                shift = b.signed(5)
                c = [b.signed(width) for _ in range(order)]
            else:
                c, shift = list(flac.FIXED[order]), 0
            method, parts = b.take(2), b.take(4)
            for p in range(1 << parts):
                k = b.take(4 + method)
                for _ in range((576 >> parts) - (order if p == 0 else 0)):
                    q = 0
                    while not b.take(1):
                        q += 1
                    u = q << k | b.take(k)
                    x.append((u >> 1 ^ -(u & 1)) + (sum(a * s for a, s in zip(c, reversed(x))) >> shift))
        b.at += -b.at % 8
        end = at + b.at // 8
        assert int.from_bytes(stream[end : end + 2], "big") == crc(stream[at:end], 0x8005, 16)
        samples += x
        at, number = end + 2, number + 1
    assert len(samples) == total and hashlib.md5(bytes(s & 255 for s in samples)).digest() == md5
    return bytes(s + 128 for s in samples)


def payloads():
    r = random.Random(3)
    tone = bytes(int(128 + 90 * np.sin(i / 9) + r.randint(-2, 2)) for i in range(3000))
    return [flac.padded(x) for x in (b"", b"abc", b"a" * 576, r.randbytes(2000), b"the cat sat on the mat. " * 60, bytes(range(256)) * 3, tone, b"\xff\xf8\x20\x02\x01" * 200, ("Ärger 😀 " * 90).encode())]


@pytest.mark.parametrize("linear", [True, False])
def test_streams_are_right_flac(linear):
    own = payloads()
    streams = flac.encode_streams(own, linear)
    for p, s in zip(own, streams):
        assert plain_reader(s) == p
    assert [s.payload for s in flac.decode_streams(streams)] == own
    used = {k for s in flac.decode_streams(streams) for k in s.kinds}
    assert {0, 1} <= used and any(8 <= k <= 12 for k in used) and any(k >= 32 for k in used) == linear


def test_frame_numbers_are_coded_as_the_format_says():
    """The code is UTF-8's, carried on to 36 bits."""
    for n in [*range(70_000), 0x10FFFF]:
        assert flac._coded_number(n) == chr(n).encode("utf-8", "surrogatepass")
    assert flac._coded_number((1 << 36) - 1) == b"\xfe" + b"\xbf" * 6 and flac._coded_number(1 << 31) == bytes([0xFE, 0x82, *[0x80] * 5])
    heads = {flac.frame_header(n): n for n in range(127, 70_000)}
    assert len(heads) == 70_000 - 127
    assert all(flac.header_at(h + b"\0", 0).number == n for h, n in heads.items())


@pytest.mark.parametrize("frames", [1, 127, 128, 129, 2100])
def test_long_streams_are_right_flac(frames):
    """Against the plain reader, beyond frame numbers of one and two bytes."""
    r = random.Random(frames)
    payload = b"".join(bytes([k % 256]) * 576 if k % 16 else r.randbytes(576) for k in range(frames))
    stream = flac.encode_streams([payload])[0]
    assert plain_reader(stream) == payload
    assert flac.decode_streams([stream])[0].payload == payload == flac.decode_any(stream).payload


def test_many_frames_and_seeking():
    payload = flac.padded(random.Random(1).randbytes(100) * 12000)
    stream = flac.encode_streams([payload])[0]
    read = flac.decode_streams([stream])[0]
    assert read.payload == payload and len(read.frame_starts) > 2050  # frame numbers of three bytes
    for sample, offset in read.seek_points:
        assert read.frame_starts[sample // 576] == offset
        assert stream[offset : offset + 2] == b"\xff\xf8"
        assert flac.read_at([stream], [offset], [sample]) == [read.pcm[sample : sample + 576]]
    with pytest.raises(flac.FlacError):
        flac.read_at([stream], [read.frame_starts[3] + 1], [576 * 3])
    with pytest.raises(flac.FlacError):
        flac.read_at([stream], [read.frame_starts[3]], [576 * 4])


def other_writer(channels, bits, block, samples, side=0, wasted=0, escape=False):
    """A stream with frames of other kinds than ours: verbatim or escaped fixed subframes, as the format describes them."""
    out, wide = [], -(-bits // 8)
    for number, at in enumerate(range(0, len(samples), block)):
        own = samples[at : at + block]
        put = []
        add = lambda v, n: put.extend((v & (1 << n) - 1) >> (n - 1 - i) & 1 for i in range(n))  # noqa: B023, E731
        code = {8: 1, 16: 4}[bits]
        add(0xFFF8, 16)
        add(7, 4)
        add(0, 4)
        add(side or channels - 1, 4)
        add(code, 3)
        add(0, 1)
        add(number, 8)
        add(len(own) - 1, 16)
        add(crc(np.packbits(put).tobytes(), 7, 8), 8)
        parts = [[x[c] for x in own] for c in range(channels)]
        if side == 8:
            parts = [parts[0], [a - b for a, b in zip(*parts)]]
        elif side == 9:
            parts = [[a - b for a, b in zip(*parts)], parts[1]]
        elif side == 10:
            parts = [[(a + b) >> 1 for a, b in zip(*parts)], [a - b for a, b in zip(*parts)]]
        for c, x in enumerate(parts):
            width = bits + (side in (8, 10) and c == 1 or side == 9 and c == 0) - wasted
            add((8 if escape else 1) << 1 | (wasted > 0), 8)
            if wasted:
                add(1, wasted)
            if escape:
                add(0, 2)
                add(0, 4)
                add(15, 4)
                add(20, 5)
            for v in x:
                add(v >> wasted, 20 if escape else width)
        put += [0] * (-len(put) % 8)
        frame = np.packbits(put).tobytes()
        out.append(frame + crc(frame, 0x8005, 16).to_bytes(2, "big"))
    pcm = b"".join((v & (1 << 8 * wide) - 1).to_bytes(wide, "little") for x in samples for v in x)
    info = block.to_bytes(2, "big") * 2 + bytes(6) + (44100 << 44 | (channels - 1) << 41 | (bits - 1) << 36 | len(samples)).to_bytes(8, "big") + hashlib.md5(pcm).digest()
    return b"fLaC\x84\0\0\x02hi"[:4] + b"\x04\0\0\x02hi" + b"\x80" + len(info).to_bytes(3, "big") + info + b"".join(out), pcm


@pytest.mark.parametrize(("channels", "bits", "block", "side", "wasted", "escape"), [(1, 8, 576, 0, 0, True), (2, 16, 4096, 0, 0, False), (2, 16, 100, 8, 0, False), (2, 16, 100, 9, 0, False), (2, 16, 100, 10, 0, True), (1, 16, 64, 0, 3, False), (1, 8, 576, 0, 2, False)])
def test_streams_of_other_writers(channels, bits, block, side, wasted, escape):
    r = random.Random(block + side)
    top = 1 << (bits - 1)
    samples = [[r.randrange(-top, top) >> wasted << wasted for _ in range(channels)] for _ in range(1152 if block == 576 else 1000)]
    stream, pcm = other_writer(channels, bits, block, samples, side, wasted, escape)
    s = flac.decode_streams([stream])[0]
    assert s.pcm == pcm and s.firsts == list(range(0, len(samples), block))
    assert flac.header_at(stream, s.frame_starts[-1]).number == len(s.firsts) - 1
    with pytest.raises(flac.FlacError):
        flac.decode_streams([stream[:-3]])


def test_header_bytes_inside_a_frame():
    """Verbatim frames that hold the next header: the footer decides."""
    noise = random.Random(5).randbytes(576 * 3)
    trap = bytes(b ^ 128 for b in flac.frame_header(1))
    payload = noise[:100] + trap + noise[100 + len(trap) :]
    stream = flac.encode_streams([payload], linear=False)[0]
    assert trap[:2] != stream[:2] and flac.decode_streams([stream])[0].payload == payload


def test_damage_is_noticed():
    stream = flac.encode_streams([payloads()[4]])[0]
    first = flac.decode_streams([stream])[0].seek_points[0][1]
    for at in (0, 30, first, first + 2, first + 6, first + 40, len(stream) // 2, len(stream) - 1):  # marker, MD5, frames
        bad = bytearray(stream)
        bad[at] ^= 4
        with pytest.raises(flac.FlacError):
            flac.decode_streams([bytes(bad)])
    with pytest.raises(flac.FlacError):
        flac.decode_streams([stream[:-40]])


def test_partitioned_residuals():
    """A frame with several Rice partitions, as other writers make them."""
    bits = []
    put = lambda v, n: bits.extend(v >> (n - 1 - i) & 1 for i in range(n))
    r = random.Random(2)
    samples = [r.randint(-20, 20) for _ in range(288)] + [r.randint(-3, 3) for _ in range(288)]
    put(8 << 1, 8)
    put(0, 2)
    put(1, 4)
    for part, k in ((samples[:288], 4), (samples[288:], 1)):
        put(k, 4)
        for s in part:
            u = -2 * s - 1 if s < 0 else 2 * s
            bits.extend([0] * (u >> k) + [1])
            put(u & (1 << k) - 1, k)
    body = np.packbits(bits).tobytes()
    x, kind, _ = flac._decode(np.frombuffer(body + b"\0" * 16, np.uint8), np.array([0]), np.array([len(body)]))
    assert x[0].tolist() == samples and kind[0] == 8


def test_media_columns(spark):
    rows = some_docs()
    media = flac.store(clashing(frame(spark, rows)))
    got = flac.features(flac.pcm_blocks(clashing(media))).collect()
    want = sorted(((i, len((t or "").encode()), hashlib.sha256(p := flac.padded((t or "").encode())).hexdigest(), zlib.crc32(p[-32:])) for i, t, *_ in rows), key=str)
    assert sorted(((r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) for r in got), key=str) == want
    by_payload = {}
    for r in got:
        assert by_payload.setdefault(r["payload_sha256"], (r["media_sha256"], r["feature"])) == (r["media_sha256"], r["feature"])
    one = flac.pcm_blocks(media.filter("doc_id = 21"), frames=2).first()
    data = bytes(one["media"])
    assert b"".join(bytes(b["pcm"]) for b in one["blocks"]) == bytes(x ^ 128 for x in plain_reader(data))
    for k, b in enumerate(one["blocks"]):
        assert b["sample_offset"] == 1152 * k and flac.read_at([data], [b["byte_offset"]], [b["sample_offset"]]) == [bytes(b["pcm"])[:576]]
    none = spark.createDataFrame([(1, 2, None)], "doc_id bigint, n_bytes bigint, media binary")
    assert flac.pcm_blocks(none).first()["blocks"] == [] and flac.features(flac.pcm_blocks(none)).collect() == []
    assert flac.features(flac.pcm_blocks(flac.store(frame(spark, [])))).collect() == []


def test_media_of_a_very_long_text(spark):
    text = "line of some words and numbers 12345\n" * 90_000  # 3.3 MB
    row = flac.features(flac.pcm_blocks(flac.store(frame(spark, [(1, text, None, None, None), (2, "x", None, None, None)])))).filter("doc_id = 1").first()
    assert row["n_bytes"] == len(text) and row["payload_sha256"] == hashlib.sha256(flac.padded(text.encode())).hexdigest()


# HTML

PAGES = "page_id bigint, url string, html string"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""), ("", ""), ("plain &amp; simple", "plain & simple"), ("<p>a<b>b</b> c<p>d<br>e", "ab c d e"), ("<article><h1>T</h1><p>x</article><p>after", "T x"),
        ("<nav>n</nav><div class='ad'>z</div><p>x<footer>f</footer>", "x"), ("<script>if(a<b)</p></script><style>p{}</style><p>x", "x"), ("<p>a<!-- <p>no --> b</p>", "a b"),
        ("<article>x<div class='comments'>c</div><aside>s</aside><form>f</form>y</article>", "x y"), ("<ul><li>a<li>b</ul>", "a b"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"),
        ("<p title=\"a>b\">x</p>", "x"), ("<p>cut off <b", "cut off"), ("<p>1 < 2 &copy; &#233;&nbsp;y", "1 < 2 © é y"), ("<body><header>h</header><main><p>m</main><p>o", "m"), ("</p></div>x", "x"),
        ("<article><header><h1>T</h1></header>x</article>", "T x"), ("<p>a<div role=navigation>n</div>b", "a b"), ("<p hidden>h</p>x", "x"), ("<div class='has-sidebar'><article class=post><div class=entry-header>T</div><p>x</article></div>", "T x"),
        ("<article>x</article><section id=comments><article>c</article></section><article class='comment'>d</article>", "x"), ("<div class='page-header'>h</div>x", "x"), ("<textarea><p>t</textarea>x", "x"),
    ],
)
def test_main_text(page, text):
    assert html_text.main_text(page) == text


def test_menus_recur_by_their_frames(spark):
    """Menus whose entries differ on every page, on pages without an article, with class words that tell nothing."""
    r = random.Random(9)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(40):
        menu = "".join(f'<li><a href="/{word()}">{word()}</a></li>' for _ in range(r.randint(3, 7)))
        trail = " / ".join(f"<a href='#'>{word()}</a>" for _ in range(r.randint(2, 4)))
        body = [" ".join(word() for _ in range(9)) for _ in range(3)]
        article = f"<h1><a href='x'>{body[0]}</a></h1><p>{body[1]}</p><p><a href='y'>{body[2]}</a></p>"
        kind = i % 3
        page = f"<div class=c1><ul>{menu}</ul></div><div class=c2>{trail}</div>" + (article, f"<article>{article}<ul>{menu}</ul></article>", f"<main>{article}</main><main><p>two {body[0][:6]}</p></main>")[kind] + f"<div class=c3>Seen {i} times, {i * 7} today</div>"
        rows.append((i, f"http://site.org/{i}", f"<body>{page}</body>"))
        entries = " ".join(x.split(">")[-1] for x in menu.split("</a>")[:-1])
        want[i] = " ".join(body) + ("", f" {entries}", f" two {body[0][:6]}")[kind]
    rows.append((99, "http://other.org/", rows[0][2]))
    got = {x["page_id"]: x["text"] for x in html_text.extract(frame(spark, rows, PAGES)).collect()}
    assert {k: v for k, v in got.items() if k != 99} == want
    assert len(got[99]) > len(got[0])  # one page alone has no template


def test_large_hosts_need_a_smaller_share(spark):
    rows = [(i, "http://big.org/", f"<div><p>Now and then</p></div><p>page {'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}{'uvwxyzabcd'[i // 100 % 10]}{'klmnop'[i // 1000]}</p>" if i % 5 == 0 else f"<p>page {i}x{'q' * (i % 97)}{'z' * (i // 97)}</p>") for i in range(3000)]
    got = html_text.extract(frame(spark, rows, PAGES), share=0.25).collect()
    assert all("Now" not in x["text"] for x in got) and len(got) == 3000
    few = html_text.extract(frame(spark, rows[:900], PAGES), share=0.25).collect()
    assert sum("Now" in x["text"] for x in few) == 180


def test_deep_and_long_pages():
    assert html_text.main_text("<div>" * 3000 + "x" + "</div>" * 3000) == "x"
    assert html_text.main_text("<p>word " * 20000) == " ".join(["word"] * 20000)


def test_templates_are_removed_by_host(spark):
    r = random.Random(6)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(6))
    rows, want = [], {}
    for i in range(60):
        host = ["one.org", "two.org", "rare.org"][0 if i < 36 else 1 if i < 57 else 2]
        body = [" ".join(word() for _ in range(8)) for _ in range(4)]
        page = f"<div><p>Welcome to {host}</p></div>" + "".join(f"<p>{b}</p>" for b in body) + f"<section><p>All rights at {host}</p></section>"
        rows.append((i, f"https://{host.upper()}/p/{i}", f"<html><body>{page}</body></html>"))
        want[i] = " ".join(body) if host != "rare.org" else f"Welcome to {host} " + " ".join(body) + f" All rights at {host}"
    copy = "<body><p>The same page everywhere.</p></body>"
    rows += [(100 + i, "http://one.org/copy", copy) for i in range(30)] + [(200, None, "<p>x</p>"), (201, "nonsense", "<p>y</p>"), (202, "http://one.org/", None), rows[0]]
    want |= {100 + i: "The same page everywhere." for i in range(30)} | {200: "x", 201: "y", 202: ""}
    got = html_text.extract(clashing(frame(spark, rows, PAGES))).collect()
    assert len(got) == len(rows)
    assert all(r["text"] == want[r["page_id"]] and r["n_chars"] == len(r["text"]) for r in got)
    assert html_text.extract(frame(spark, [], PAGES)).collect() == []
