import io
import zipfile

import pyarrow as pa

from veilspark.catalog.intake import as_docx
from veilspark.operators.admit import MAX_SIZE, file_reject_reason
from veilspark.operators.secrets import ALLOWED_PATHS
from veilspark.plans.scan import ScanOptions
from veilspark.plans.audit import audit_files
from veilspark.plans.files import scan_files
from veilspark.sources.files import docx_text, extract_files, read_files, small_parts

NS = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'


def docx(*paragraphs):
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        archive.writestr("word/document.xml", f"<w:document {NS}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def tree(root):
    files = {
        "a.txt": "mail jan@x.nl".encode(),
        "deep/b.JSON": b'{"token": "abcdef123456"}',
        "deep/.env": b"DB_PASSWORD=supersecret1",
        "README": b"bsn 111222333",
        "empty.md": b"",
        "bad.log": b"ip 10.0.0.1 \xff\xfe",
        "brief.docx": docx("Geachte jan@x.nl", "tot ziens"),
        "leeg.docx": docx("  "),
        "stuk.docx": b"not a zip",
        "scan.pdf": b"%PDF-1.4",
        "tool.exe": b"MZ",
        "node_modules/x.js": b"token = 'abcdef123456'",
    }
    for name, content in files.items():
        path = root / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(content)
    return str(root)


def test_scan_files(spark, tmp_path):
    results, rejected = scan_files(spark, tree(tmp_path / "in"), "standard")
    got = {r["filename"]: r for r in results.collect()}
    assert {k: v["sanitized"] for k, v in got.items()} == {
        "a.txt": "mail [EMAIL_ADDRESS]",
        "b.JSON": '{"token": "[REDACTED:quoted-secret-assignment]"}',
        ".env": "DB_PASSWORD=[REDACTED:unquoted-credential]",
        "README": "bsn [BSN]",
        "empty.md": "",
        "bad.log": "ip [IP_ADDRESS] ��",
        "brief.docx": "Geachte [EMAIL_ADDRESS]\n\ntot ziens\n\n",
        "x.js": "token = '[REDACTED:quoted-secret-assignment]'",
    }
    assert (got["brief.docx"]["extracted"], got["brief.docx"]["source_type"], got["brief.docx"]["extracted_length"]) == (True, "Word", 29)
    assert (got[".env"]["file_type"], got["b.JSON"]["file_type"]) == ("", ".json")
    assert {r["filename"]: r["reject_reason"] for r in rejected.collect()} == {
        "leeg.docx": "extraction_failed", "stuk.docx": "extraction_failed", "scan.pdf": "extraction_failed", "tool.exe": "type_not_supported"
    }
    audit = {r["filename"]: r for r in audit_files(results).collect()}
    assert audit["a.txt"]["findings_count"] == 1 and "sanitized" not in audit_files(results).columns


def test_own_extractor(spark, tmp_path):
    texts, rejected = read_files(spark, tree(tmp_path / "in"), {".pdf": lambda content: content.decode() + " a@b.nl"})
    assert {r["source_type"]: r["text"] for r in texts.filter("file_type = '.pdf'").collect()} == {"PDF": "%PDF-1.4 a@b.nl"}
    assert rejected.filter("file_type = '.pdf'").count() == 0


def test_size_gate(spark):
    df = spark.createDataFrame([("/a.txt", MAX_SIZE), ("/a.txt", MAX_SIZE + 1), ("/a.bin", 1), ("/a.", 1)], "path string, length long")
    rows = df.select(file_reject_reason(df.path, df.length).alias("r")).collect()
    assert [r["r"] for r in rows] == [None, "file_too_large", "type_not_supported", "type_not_supported"]


def test_word_text_is_walked_once():
    box = "<w:p><w:r><w:t>vak</w:t></w:r></w:p>"
    body = (
        "<w:p><w:pPr><w:tabs><w:tab w:val='left'/></w:tabs></w:pPr><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t>"
        f"<m:AlternateContent xmlns:m='urn:m'><m:Choice>{box}</m:Choice><m:Fallback>{box}</m:Fallback></m:AlternateContent></w:r></w:p>"
    )
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
        archive.writestr("word/document.xml", f"<w:document xmlns:w='{ns}'><w:body>{body}</w:body></w:document>")
    assert docx_text(out.getvalue()) == "a\tb\n\nvak\n\n"


def test_path_allowlist_is_opt_in(spark, tmp_path):
    root = tree(tmp_path / "in")
    for allowed, n_secret in (((), 1), (ALLOWED_PATHS, None)):
        results, _ = scan_files(spark, root, "quick", options=ScanOptions(allowed_paths=allowed))
        got = {r["filename"]: r for r in results.collect()}
        assert got["x.js"]["n_secret"] == n_secret
        assert got[".env"]["n_secret"] == 1


def test_documents_are_made_and_extracted_in_small_parts(spark):
    texts = [f"{i} " + "ab\n" * 10_000 for i in range(200)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(200)), "text": texts})
    made = list(as_docx(iter([batch])))
    assert sum(b.num_rows for b in made) == 200 and max(b.num_rows for b in made) < 50
    assert [b.num_rows for b in small_parts(pa.RecordBatch.from_pydict({"c": [b"x" * 9, None, b"", b"x", b"x" * 20, b"y"]}), "c", 10)] == [4, 1, 1]
    files = spark.createDataFrame([(i, ".docx", docx(t), None) for i, t in enumerate(["a", "b\tc", " "])] + [(3, ".docx", b"no zip", None)], "doc_id long, file_type string, content binary, reject_reason string")
    assert {r.doc_id: r.text for r in extract_files(files).collect()} == {0: "a\n\n", 1: "b\tc\n\n", 2: None, 3: None}
