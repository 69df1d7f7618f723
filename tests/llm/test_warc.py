import hashlib

from cohortlens.llm import warc

PAGES = "page_id long, url string, html string, payload string, uri int"
LONG = "<p>é" + "x" * 200


def rows():
    return [(3, "http://a/", LONG, None, 1), (1, "http://b/\r\nX: y", LONG, "p", 2), (2, None, LONG, "p", 3), (4, "u", "tiny", "q", 4), (5, "u", "tiny", "q", 4),
            (6, "", None, None, None), (7, "u", "", "q", 4), (8, "u", LONG + "2", "q", 4), (8, "u", LONG + "2", "q", 4), (None, "u", LONG, "q", 4),
            (9, "u", "\r\n\r\nWARC/1.1\r\n" * 30_000, "q", 4)]


def test_round_trip_and_revisits(make, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 300)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 1000)
    pages = make(rows(), PAGES).coalesce(1)
    bundles = warc.write_bundles(warc.decisions(pages))
    got = warc.read_bundles(bundles).collect()
    assert len(got) == len(rows())
    html = {r[0]: (r[2] or "").encode() for r in rows()}
    for r in got:
        assert r.payload_digest == hashlib.sha256(html[r.page_id]).hexdigest() and r.payload_bytes == len(html[r.page_id])
        assert r.payload == (html[r.page_id] if r.record_type == "response" else b"")
    kinds = {r.page_id: (r.record_type, r.refers_to) for r in got}
    assert kinds[1] == ("response", None) and kinds[2] == kinds[3] == kinds[None] == ("revisit", 1)
    assert kinds[4] == kinds[5] == kinds[6] == kinds[7] == kinds[8] == ("response", None)
    uris = {r.page_id: r.uri for r in got}
    assert uris[1] == "http://b/%0D%0AX: y" and uris[2] is None and uris[6] == ""
    wanted = make([(9,), (3,), (77,)], "page_id long")
    assert {r.page_id: r.record_type for r in warc.fetch(bundles, wanted).collect()} == {9: "response", 3: "revisit"}
    assert warc.index(bundles).count() == len(rows())


def test_seek_table_is_the_public_format(make):
    bundle = warc.write_bundles(warc.decisions(make(rows(), PAGES).coalesce(1))).first()
    content = bytes(bundle.content)
    frames = warc.read_seek_table(content)
    assert content[-4:] == (0x8F92EAB1).to_bytes(4, "little")
    body = len(content) - 8 - 8 * len(frames) - 9
    assert content[body: body + 4] == (0x184D2A5E).to_bytes(4, "little")
    import zstandard
    plain = b"".join(zstandard.ZstdDecompressor().decompress(content[a: a + p], max_output_size=n) for a, p, n in frames)
    assert plain.startswith(b"WARC/1.1\r\nWARC-Type: ")
    with zstandard.ZstdDecompressor().stream_reader(content, read_across_frames=True) as r:  # a plain reader skips the table
        assert r.read() == plain


def test_empty(make):
    assert warc.read_bundles(warc.write_bundles(warc.decisions(make([], PAGES)))).count() == 0
