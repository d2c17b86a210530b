"""PDF files of each kind, written by hand: page order, object and cross-reference streams, maps to Unicode, updates, forms."""

import zlib

import pytest

from learngraph.sources import documents, pdf


def stream(body, extra=b"", packed=True):
    body = zlib.compress(body) if packed else body
    return b"<< /Length %d %s %s >>\nstream\n%s\nendstream" % (len(body), b"/Filter /FlateDecode" if packed else b"", extra, body)


def classic(objects, trailer=b"trailer << /Root 1 0 R >>"):
    return b"%PDF-1.4\n" + b"".join(b"%d 0 obj\n%s\nendobj\n" % (n, body) for n, body in objects) + trailer + b"\nstartxref\n0\n%%EOF"


CATALOG = [(1, b"<< /Type /Catalog /Pages 2 0 R >>")]


def test_pages_come_in_the_order_of_the_tree():
    objects = [
        (9, stream(b"BT /F1 9 Tf (third) Tj ET")), (7, stream(b"BT (first \\(one\\)) Tj 0 -12 Td (line two) Tj ET")), *CATALOG,
        (2, b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 3 >>"), (4, b"<< /Type /Pages /Kids [6 0 R 12 0 R] /Parent 2 0 R >>"),
        (3, b"<< /Type /Page /Contents 7 0 R >>"), (6, b"<< /Type /Page /Contents [10 0 R 11 0 R] >>"), (12, b"<< /Type /Page /Contents 9 0 R >>"),
        (10, stream(b"BT (sec", packed=False)), (11, stream(b"ond) Tj ET q 1 0 0 1 0 0 cm Q", packed=False)),
    ]
    found = documents.pdf_pages(classic(objects))
    assert found[0] == (1, "first (one)\nline two") and found[2] == (3, "third") and found[1][0] == 2
    empty = classic([*CATALOG, (2, b"<< /Kids [3 0 R 4 0 R] >>"), (3, b"<< /Type /Page >>"), (4, b"<< /Type /Page /Contents 7 0 R >>"), (7, stream(b"BT (x) Tj ET"))])
    assert documents.pdf_pages(empty) == [(2, "x")]


def test_object_streams_and_cross_reference_streams_with_predictors():
    inner = [(1, b"<< /Type /Catalog /Pages 2 0 R >>"), (2, b"<< /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Contents 5 0 R >>")]
    heads, bodies = b"", b""
    for n, body in inner:
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    holder = stream(heads + bodies, b"/Type /ObjStm /N 3 /First %d" % len(heads))
    rows = bytes([0, 0, 0, 0] * 3)
    coded = b"".join(b"\x02" + rows[k : k + 4] for k in range(0, 12, 4))
    table = stream(coded, b"/Type /XRef /W [1 2 1] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 4 >>")
    data = b"%PDF-1.5\n5 0 obj\n" + stream(b"BT (in a stream) Tj ET") + b"\nendobj\n6 0 obj\n" + holder + b"\nendobj\n7 0 obj\n" + table + b"\nendobj\nstartxref\n0\n%%EOF"
    assert documents.pdf_pages(data) == [(1, "in a stream")]
    coded = b"".join(bytes([kind]) + bytes(row) for kind, row in ((0, [1, 2, 3]), (1, [1, 1, 1]), (2, [1, 1, 1]), (3, [1, 1, 1]), (4, [1, 1, 1])))
    assert pdf._undone(coded, 3, 15) == bytes([1, 2, 3, 1, 2, 3, 2, 3, 4, 2, 3, 4, 3, 4, 5])


CMAP = b"""/CIDInit /ProcSet findresource begin 1 begincodespacerange <0000> <FFFF> endcodespacerange
2 beginbfchar <0001> <0048> <0002> <D83DDE00> endbfchar
2 beginbfrange <0010> <0013> <0061> <0020> <0021> [<00660069> <00E9>] endbfrange endcmap"""


def test_fonts_maps_to_unicode():
    objects = [
        *CATALOG, (2, b"<< /Kids [3 0 R] /Resources << /Font << /F1 4 0 R /F2 8 0 R >> >> >>"), (3, b"<< /Type /Page /Contents 7 0 R >>"),
        (4, b"<< /Subtype /Type0 /Encoding /Identity-H /ToUnicode 5 0 R >>"), (5, stream(CMAP)), (8, b"<< /Subtype /Type1 /Encoding << /Differences [65 /uni20AC /b] >> >>"),
        (7, stream(b"BT /F1 12 Tf <00010010001100120013> Tj [<0020> -300 <0021> -20 <0002>] TJ T* /F2 9 Tf (AB\\374\\223) Tj ET")),
    ]
    assert documents.pdf_pages(classic(objects)) == [(1, "Habcdfi é😀\n€bü“")]


def test_updates_replace_objects_and_forms_are_read():
    first = classic([*CATALOG, (2, b"<< /Kids [3 0 R] >>"), (3, b"<< /Type /Page /Contents 7 0 R /Resources << /XObject << /X 8 0 R >> >> >>"), (7, stream(b"BT (old) Tj ET")), (8, stream(b"BT (form) Tj ET /X Do", b"/Subtype /Form"))])
    second = b"\n7 0 obj\n" + stream(b"BT (new) Tj ET /X Do") + b"\nendobj\ntrailer << /Root 1 0 R /Prev 5 >>"
    assert documents.pdf_pages(first + second) == [(1, "new\nform\nform\nform\nform\nform\nform\nform\nform")]


def test_damaged_and_encrypted_files():
    with pytest.raises(ValueError, match="encrypted"):
        documents.pdf_pages(classic(CATALOG, b"trailer << /Root 1 0 R /Encrypt 4 0 R >>"))
    assert documents.pdf_pages(b"") == [] and documents.pdf_pages(b"%PDF-1.4\n1 0 obj << /Type") == []
    loop = classic([*CATALOG, (2, b"<< /Kids [2 0 R 3 0 R] >>"), (3, b"<< /Kids [2 0 R] >>")])
    assert documents.pdf_pages(loop) == []
    missing = classic([*CATALOG, (2, b"<< /Kids [3 0 R] >>"), (3, b"<< /Contents 99 0 R >>")])
    assert documents.pdf_pages(missing) == []
