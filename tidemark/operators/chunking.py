"""Chunking (CHK-1 to CHK-12): one document to many chunks, row by row, so nothing is shuffled.

Packing text greedily under a budget is a fold with state over a document's lines or
sentences; these folds run in Python workers on Arrow batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType, _parse_datatype_string

from ..config import EngineConfig
from ..functions.pytext import estimate_tokens, fenced, first_free, sentences, slugify, tokens
from ..session import spread

#: Metadata of all sources; a source leaves the others' null.
META = (
    "doc_id string, title string, doc_type string, version string, product_area string, last_updated string, canonical boolean, url string, tags array<string>, status string, views bigint, created_at string, published_at string, "
    "product_version_mentioned string, product_version_at_time string, author string, author_role string, post_id string, votes bigint, is_accepted boolean, corroborating_followups bigint, unanswered boolean, "
    "section_title string, section_path array<string>, heading_level bigint, window_index bigint, window_count bigint, chunker string"
)
CHUNK = f"chunk_id string, source string, doc_pos bigint, text string, display_text string, context_header string, token_count bigint, parent_id string, {META}"
#: Characters of chunks that a worker holds before it hands them on.
SLICE = 1 << 20
HEADING = re.compile(r"^(#{1,6})\s+(.*?)\s*#*\s*$")
QUOTE = re.compile(r"^\s*>.*$", re.MULTILINE)


def headers(config: EngineConfig) -> Callable[[str, dict, dict], str]:
    """CHK-11: the context header of a chunk, by source."""
    on, brand = config.get("chunking.contextual.enabled"), config.get("brand")
    with_version, with_date, with_authority = (config.get(f"chunking.contextual.include_{k}") for k in ("version", "date", "authority"))

    def header(source: str, doc: dict, own: dict) -> str:
        if not on:
            return ""
        parts: list[str | None] = []
        if source == "docs":
            version = doc.get("version") if with_version else None
            kind = doc.get("doc_type")
            parts = [f"{brand} Docs v{version}" if version else f"{brand} Docs", kind if kind != "reference" else None, doc.get("title"), *own.get("section_path", [])]
        elif source == "forum":
            version = doc.get("product_version_mentioned") if with_version else None
            parts = [f"{brand} Forum", doc.get("status"), version and f"v{version}", doc.get("title") and f'"{doc["title"]}"']
            if with_authority:
                role = own.get("author_role") or "user"
                parts.append("original question" if own.get("parent_post_id") is None else f"accepted answer by {role}" if own.get("is_accepted") else f"answer by {role} ({own.get('votes') or 0} votes)")
        elif source == "blog":
            date = doc.get("published_at") if with_date else None
            era = doc.get("product_version_at_time") if with_version else None
            parts = [f"{brand} Blog", f"{date} (v{era} era)" if date and era else date or (era and f"v{era} era"), doc.get("author_role") if with_authority else None, doc.get("title") and f'"{doc["title"]}"']
        return " > ".join(str(p) for p in parts if p)

    return header


def heading_sections(body: str) -> list[dict]:
    """CHK-1: sections with level, title, path and lines. A first-level heading starts anew without a title of its own; headings in fences do not count."""
    lines = body.splitlines()
    found = [{"level": 1, "title": "", "path": [], "lines": []}]
    open_: list[tuple[int, str]] = []
    for line, code in zip(lines, fenced(lines), strict=True):
        m = None if code else HEADING.match(line)
        if m is None:
            found[-1]["lines"].append(line)
            continue
        level = len(m[1])
        open_ = [] if level == 1 else [*(x for x in open_ if x[0] < level), (level, m[2])]
        found.append({"level": level, "title": "" if level == 1 else m[2], "path": [t for _, t in open_], "lines": []})
    return [s for s in found if section_body(s)]


def section_body(section: dict) -> str:
    return "\n".join(section["lines"]).strip()


def merge_small(sections: list[dict], least: int, most: int) -> list[dict]:
    """CHK-2: a section under ``least`` tokens goes to the one before it while both fit; the last one in any case."""

    def join(into: dict, section: dict) -> None:
        into["lines"] += ["", *([f"{'#' * section['level']} {section['title']}"] if section["title"] else []), *section["lines"]]

    size = lambda s: estimate_tokens(section_body(s))
    kept: list[dict] = []
    for section in sections:
        if kept and size(section) < least and size(kept[-1]) + size(section) <= most:
            join(kept[-1], section)
        else:
            kept.append(section)
    if len(kept) > 1 and size(kept[-1]) < least:
        last = kept.pop()
        join(kept[-1], last)
    return kept


def paragraphs(text: str) -> list[str]:
    """Runs of lines between blank lines outside fences."""
    lines = text.splitlines()
    found: list[list[str]] = [[]]
    for line, code in zip(lines, fenced(lines), strict=True):
        if line.strip() or code:
            found[-1].append(line)
        elif found[-1]:
            found.append([])
    return ["\n".join(p) for p in found if p]


def split_long(text: str, most: int, overlap: int) -> list[str]:
    """CHK-3: paragraphs packed up to ``most`` tokens; the last ``overlap`` sentences begin the next piece, unless they are code or long."""
    if estimate_tokens(text) <= most:
        return [text]
    pieces: list[list[str]] = [[]]
    used = 0
    for p in paragraphs(text):
        n = estimate_tokens(p)
        if pieces[-1] and used + n > most:
            tail = " ".join(sentences("\n\n".join(pieces[-1]))[-overlap:]).strip() if overlap > 0 else ""
            tail = "" if "```" in tail or len(tail) > 400 else tail
            pieces.append([tail] if tail else [])
            used = estimate_tokens(tail)
        pieces[-1].append(p)
        used += n
    return [p for p in ("\n\n".join(x) for x in pieces) if p.strip()]


def docs_chunks(config: EngineConfig) -> Callable[[dict], Iterator[dict]]:
    """CHK-4."""
    least, most, overlap = (config.get(f"chunking.docs.{k}") for k in ("min_tokens", "max_tokens", "split_overlap_sentences"))
    header = headers(config)

    def run(doc: dict) -> Iterator[dict]:
        taken: set[str] = set()
        parents: dict[str, str] = {}
        for s in merge_small(heading_sections(doc["body"] or ""), least, most):
            for i, piece in enumerate(split_long(section_body(s), most, overlap)):
                slug = first_free((slugify(s["title"]) or "body") + (f"-p{i + 1}" if i else ""), taken)
                name = f"docs:{doc['doc_id']}:{slug}"
                top = s["path"][0] if s["path"] else None
                parent = parents.get(top) if top else None
                own = {"section_title": s["title"], "section_path": s["path"], "heading_level": s["level"], "chunker": "heading_tree"}
                yield {"chunk_id": name, "display_text": piece, "context_header": header("docs", doc, own), "parent_id": parent, **own}
                if s["level"] == 2 and top:
                    parents.setdefault(top, name)

    return run


def thread_chunks(config: EngineConfig) -> Callable[[dict], Iterator[dict]]:
    """CHK-5 to CHK-7: the question with each answer that is kept and its follow-ups; a thread without one is its question."""
    least_votes, follow_ups, unquote, most = (config.get(f"chunking.forum.{k}") for k in ("min_votes_for_non_accepted", "include_op_followups", "strip_quoted_replies", "max_question_tokens"))
    header = headers(config)
    clean = lambda text: re.sub(r"\n{3,}", "\n\n", QUOTE.sub("", text or "") if unquote else text or "").strip()

    def named(post: dict) -> str:
        return ", ".join([post.get("author_role") or "user", *(["accepted"] if post.get("is_accepted") else []), f"{post.get('votes') or 0} votes"])

    def shortened(text: str) -> str:
        if estimate_tokens(text) <= most:
            return text
        kept, used = [], 0
        for s in sentences(text):
            used += estimate_tokens(s)
            if used > most:
                break
            kept.append(s)
        return " ".join(kept) or text[:600]

    def run(doc: dict) -> Iterator[dict]:
        posts = doc["posts"] or []
        if not posts:
            return
        first = next((p for p in posts if p["parent_post_id"] is None), posts[0])
        question = f"QUESTION: {doc['title'] or ''}\n{shortened(clean(first['body']))}".strip()
        replies: dict[str, list[dict]] = {}
        for p in posts:
            if p["parent_post_id"]:
                replies.setdefault(p["parent_post_id"], []).append(p)
        answered = False
        for a in replies.get(first["post_id"], []):
            if not (a["is_accepted"] or a["author_role"] in ("staff", "mvp") or (a["votes"] or 0) >= least_votes):
                continue
            answered = True
            own_replies = replies.get(a["post_id"], []) if a["post_id"] != first["post_id"] else []
            said = [question, f"ANSWER ({named(a)}):\n{clean(a['body'])}", *([f"FOLLOW-UP ({named(f)}):\n{clean(f['body'])}" for f in own_replies] if follow_ups else [])]
            yield {
                "chunk_id": f"forum:{doc['doc_id']}:{a['post_id']}", "display_text": "\n\n".join(said), "context_header": header("forum", doc, a), "parent_id": f"forum:{doc['doc_id']}",
                "post_id": a["post_id"], "author": a["author"], "author_role": a["author_role"] or "user", "votes": a["votes"] or 0, "is_accepted": bool(a["is_accepted"]),
                "created_at": a["created_at"] or doc.get("created_at"), "corroborating_followups": len(own_replies), "chunker": "thread_qa_pair",
            }
        if not answered:
            yield {
                "chunk_id": f"forum:{doc['doc_id']}:{first['post_id'] or 'p1'}", "display_text": question, "context_header": header("forum", doc, first), "parent_id": f"forum:{doc['doc_id']}",
                "post_id": first["post_id"], "author_role": first["author_role"] or "user", "votes": first["votes"] or 0, "is_accepted": False, "created_at": first["created_at"], "unanswered": True, "chunker": "thread_qa_pair",
            }

    return run


def sliding_windows(parts: list[str], most: int, ratio: float) -> list[list[str]]:
    """CHK-8: sentences packed up to ``most`` tokens; a window begins with the last ones of the window before, up to ``ratio`` of it."""
    room = int(most * ratio)
    cost = [estimate_tokens(s) for s in parts]
    found: list[list[int]] = [[]]
    used = 0
    for i, n in enumerate(cost):
        if found[-1] and used + n > most:
            at, used = len(found[-1]), 0
            while at > 0 and used + cost[found[-1][at - 1]] <= room:
                at -= 1
                used += cost[found[-1][at]]
            found.append(found[-1][at:])
        found[-1].append(i)
        used += n
    return [[parts[i] for i in w] for w in found if w]


def semantic_windows(parts: list[str], most: int, percentile: float, words: Callable[[str], set[str]]) -> list[list[str]]:
    """CHK-9: cut where neighbouring sentences share least (at or under the percentile), once a window is 0.4 full, or when it is full."""
    if len(parts) < 3:
        return [parts]
    sets = [words(s) for s in parts]
    alike = [len(a & b) / len(a | b) if a | b else 0.0 for a, b in zip(sets, sets[1:], strict=False)]
    low = sorted(alike)[max(0, min(len(alike) - 1, int(len(alike) * percentile / 100)))]
    found, used = [[parts[0]]], estimate_tokens(parts[0])
    for s, a in zip(parts[1:], alike, strict=True):
        n = estimate_tokens(s)
        if (a <= low and used >= most * 0.4) or used + n > most:
            found.append([])
            used = 0
        found[-1].append(s)
        used += n
    return found


def article_chunks(config: EngineConfig) -> Callable[[dict], Iterator[dict]]:
    most, ratio, semantic, percentile = (config.get(f"chunking.blog.{k}") for k in ("window_tokens", "overlap_ratio", "semantic_split", "semantic_percentile"))
    header = headers(config)

    def run(doc: dict) -> Iterator[dict]:
        parts = sentences(doc["body"] or "")
        windows = (semantic_windows(parts, most, percentile, lambda s: set(tokens(s))) if semantic else sliding_windows(parts, most, ratio)) if parts else []
        for i, w in enumerate(windows):
            yield {"chunk_id": f"blog:{doc['doc_id']}:w{i}", "display_text": " ".join(w), "context_header": header("blog", doc, {}), "parent_id": f"blog:{doc['doc_id']}", "window_index": i, "window_count": len(windows), "chunker": "semantic_window" if semantic else "sliding_window"}

    return run


def uniform_chunks(source: str, config: EngineConfig) -> Callable[[dict], Iterator[dict]]:
    """CHK-10: windows of words of one size, whatever the source; the control."""
    size = max(1, int(config.get("chunking.uniform.chunk_tokens") / 1.3))
    step = max(1, size - max(0, int(config.get("chunking.uniform.overlap_tokens") / 1.3)))

    def run(doc: dict) -> Iterator[dict]:
        posts = doc.get("posts")
        words = f"{doc['title'] or ''}\n\n{chr(10).join(p['body'] or '' for p in posts) if posts else doc['body'] or ''}".split()
        last = max(0, -(-(len(words) - size) // step))
        for i in range(last + 1 if words else 0):
            yield {"chunk_id": f"{source}:{doc['doc_id']}:u{i}", "display_text": " ".join(words[i * step : i * step + size]), "context_header": "", "parent_id": f"{source}:{doc['doc_id']}", "window_index": i, "chunker": "uniform"}

    return run


def chunk(documents: DataFrame, source: str, config: EngineConfig) -> DataFrame:
    """CHK-12: the chunks of one source's documents by the configured strategy. ``doc_pos`` orders the source's chunks: the document's place (under 2^32), then the chunk's (under 2^31, as a text has no more characters)."""
    makers = {"docs": docs_chunks, "forum": thread_chunks, "blog": article_chunks}
    make = uniform_chunks(source, config) if config.get("chunking.strategy") == "uniform" else makers[source](config)
    schema: StructType = _parse_datatype_string(CHUNK)
    names = schema.fieldNames()
    arrow = pa.schema([(f.name, pa_type(f.dataType.simpleString())) for f in schema.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, held = [], 0
        for batch in batches:
            for at in range(batch.num_rows):
                # A document at a time, so that a worker holds one as objects and no more than SLICE characters of chunks, however many rows a batch has.
                doc = batch.slice(at, 1).to_pylist()[0]
                for i, c in enumerate(make(doc)):
                    body = c["display_text"].strip()
                    text = f"{c['context_header']}\n\n{body}" if c["context_header"] else body
                    row = {k: doc.get(k) for k in names} | c | {"source": source, "doc_pos": ((doc.get("doc_pos") or 0) << 31) + i, "text": text, "display_text": body, "token_count": estimate_tokens(text)}
                    rows.append({k: row.get(k) for k in names})
                    held += len(text) + len(body)
                    if held >= SLICE:
                        yield pa.RecordBatch.from_pylist(rows, schema=arrow)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_pylist(rows, schema=arrow)

    return documents.mapInArrow(run, schema)


def pa_type(name: str) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}[name]


def chunk_corpus(corpus: dict[str, DataFrame], config: EngineConfig) -> DataFrame:
    parts = [chunk(spread(documents), source, config) for source, documents in corpus.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def version_of(prefix: str = ""):
    """A chunk's version: the first that is not empty of its own, the one mentioned, the one at the time."""
    return F.coalesce(*[F.nullif(F.col(f"{prefix}{c}"), F.lit("")) for c in ("version", "product_version_mentioned", "product_version_at_time")])
