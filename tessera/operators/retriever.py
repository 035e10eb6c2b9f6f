"""Whole flows: index a source tree, answer a question, prepare training files."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import analyze
from tessera.functions import values as V
from tessera.functions.text import chunk_id, embedding_text, language_of, splitlines
from tessera.operators import chunking, code, search, store, strategies, training
from tessera.operators.embedding import embed, hashed_terms
from tessera.session import bounded, checkpointed
from tessera.sources import files

COLUMNS = ["id", "content", "language", "chunk_type", "file_path", "start_line", "end_line", "class_name", "method_name", "documentation", "references", "metadata"]
#: Classes that the answer to a question for all of them has in its prompt.
LISTED = 1000
#: Characters of a source that previews show: of sources, dependencies and templates.
PREVIEWS = {"sources": 1000, "dependencies": 500, "templates": 1500}
SYSTEM_PROMPT = "You answer questions about a code base from the snippets that you are given, and say so when they do not hold the answer."


def _shaped(chunks: DataFrame) -> DataFrame:
    for name, kind in (("method_name", "string"), ("class_name", "string"), ("documentation", "string"), ("references", "array<string>"), ("metadata", "string"), ("start_line", "int"), ("end_line", "int")):
        chunks = chunks.withColumn(name, F.col(name).cast(kind) if name in chunks.columns else F.lit(None).cast(kind))
    return chunks.select(*COLUMNS)


def scan(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks of all Java files, other code, JSON templates and documents of a tree; references are classes of the tree."""
    types = code.java_types(files.relative(files.java_files(spark, folder), folder))
    blocks = code.block_chunks(code.generic_blocks(files.relative(files.code_files(spark, folder), folder)))
    known = types.filter("parent = -1").select(F.col("name").alias("__known")).distinct()
    named = blocks.select("id", F.explode("references").alias("__known")).join(known, "__known", "left_semi").groupBy("id").agg(F.array_sort(F.collect_set("__known")).alias("references"))
    blocks = blocks.drop("references").join(named, "id", "left")
    templates = chunking.template_chunks(files.template_files(spark, folder)).withColumn("language", F.lit("json")).withColumnRenamed("path", "file_path")
    templates = templates.withColumn("metadata", F.to_json(F.struct(F.col("name").alias("template_name"), "section", "keys")))
    docs = files.document_files(spark, folder)
    cut = chunking.document_sections(docs.filter(F.size(splitlines(F.col("text"))) >= V.MIN_CHUNK_LINES))
    lines = splitlines(F.col("content"))
    cut = cut.filter(F.size(lines) >= V.MIN_CHUNK_LINES).select(
        chunk_id(F.col("path"), F.col("section"), F.lit("document")).alias("id"), chunking.truncated(lines).alias("content"), "language", F.lit("document").alias("chunk_type"),
        F.col("path").alias("file_path"), "start_line", (F.col("start_line") + F.size(lines) - 1).alias("end_line"), F.to_json(F.struct(F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1).alias("document_name"), "section")).alias("metadata"),
    )
    return _shaped(code.java_chunks(types)).unionByName(_shaped(blocks)).unionByName(_shaped(templates)).unionByName(_shaped(cut))


def scan_file(spark: SparkSession, path: str, base: str | None = None) -> DataFrame:
    """Chunks of one file by its suffix: Java declarations, or blocks of a known language; another file has none. Paths are
    below ``base``, else below the file's folder; references are classes of the file."""
    file = files.relative(files.one_file(spark, path), base or path.rpartition("/")[0] or ".")
    if path.endswith(".java"):
        return _shaped(code.java_chunks(code.java_types(file)))
    known = file.withColumn("language", language_of(F.col("path"), V.LANGUAGES)).filter("language IS NOT NULL")
    return _shaped(code.block_chunks(code.generic_blocks(known)))


def index(spark: SparkSession, folder: str, into: store.ChunkStore, reset: bool = False, dry_run: bool = False, model: Callable = hashed_terms) -> DataFrame:
    """Scans, embeds and upserts a tree; gives the counts by language and type. dry_run: counts only."""
    chunks = scan(spark, folder)
    if dry_run:
        return chunks.groupBy("language", "chunk_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("references") > 0).alias("with_references"))
    text = embedding_text(F.col("language"), F.col("chunk_type"), F.col("class_name"), F.col("method_name"), F.col("documentation"), F.col("content"))
    ready = embed(chunks.withColumn("__text", text), "__text", into.dims, model).filter("embedding IS NOT NULL")
    if reset:
        into.create()
    into.upsert(ready.drop("__text", "reason").withColumn("created_at", F.lit(None).cast("timestamp")).withColumn("seq", F.monotonically_increasing_id()))
    now = into.read()
    return now.groupBy("language", "chunk_type").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.size("references") > 0).alias("with_references"))


@dataclass
class Answer:
    """sources: chunks with rank and score; dependencies: chunks; prompt: for the language model; answer: its text, if one is given."""

    question: str
    analysis: dict
    sources: DataFrame
    dependencies: DataFrame | None
    context: str
    prompt: str
    answer: str | None = None


class Retriever:
    """Questions over a chunks table (COLUMNS and embedding). model embeds, generate (prompt -> text) answers; both are pluggable."""

    def __init__(self, chunks: DataFrame, dims: int = 768, model: Callable = hashed_terms, generate: Callable[[str], str] | None = None):
        self.chunks, self.dims, self.model, self.generate = chunks, dims, model, generate

    def analyse(self, question: str) -> dict:
        text = F.col("q")
        row = self.chunks.sparkSession.createDataFrame([(question,)], "q string").select(
            analyze.intent(text).alias("intent"), analyze.class_names(text).alias("classes"), analyze.method_names(text).alias("methods"), analyze.primary_terms(text).alias("terms"),
            analyze.expanded_terms(analyze.primary_terms(text)).alias("expanded"), analyze.search_keywords(text).alias("keywords"), analyze.recommendation(analyze.intent(text), analyze.class_names(text)).alias("r"),
        ).first()
        return row.asDict(recursive=True)

    def _filtered(self, language: str | None, chunk_type: str | None) -> DataFrame:
        out = self.chunks
        out = out if language is None else out.filter(F.col("language") == language)
        return out if chunk_type is None else out.filter(F.col("chunk_type") == chunk_type)

    def retrieve_only(self, question: str, top_k: int = 10, language: str | None = None, chunk_type: str | None = None) -> DataFrame:
        """(id, similarity) by vectors alone, without a threshold."""
        return self._vector(self._filtered(language, chunk_type), question, top_k, None)

    def _vector(self, chunks: DataFrame, question: str, k: int, threshold: float | None) -> DataFrame:
        return search.vector_topk(chunks, self.model([question], self.dims)[0], k, threshold, id_col="id")

    def _enums_of(self, name: str, language: str | None) -> DataFrame:
        """id and place of the enums that belong to a class, the best ones first, by the prefix of their name or the parent in their metadata: among the best of
        a keyword search, else of a vector search."""
        enums = self._filtered(language, "enum")
        own = enums.filter(F.startswith("class_name", F.lit(f"{name}.")) | (F.get_json_object("metadata", "$.parent_class") == name)).select("id")
        found = search.keyword_search(enums, [f"{name}.Type", f"{name}.Category", name, "enum"], 10).join(own, "id", "left_semi").select("id", (-F.col("relevance")).alias("place"))
        return found if not found.isEmpty() else self._vector(enums, f"{name} enum inner enum Type Category", 5, 0.3).join(own, "id", "left_semi").select("id", (-F.col("similarity")).alias("place"))

    def query(self, question: str, top_k: int | None = None, language: str | None = None, chunk_type: str | None = None, include_dependencies: bool | None = None, max_dependencies: int = 3, hybrid: bool = True, min_similarity: float | None = None) -> Answer:
        a = self.analyse(question)
        r = a["r"]
        k, threshold = top_k or r["top_k"], r["min_similarity"] if min_similarity is None else min_similarity
        with_dependencies = r["include_dependencies"] if include_dependencies is None else include_dependencies
        kind = r["chunk_type"] if chunk_type is None else chunk_type
        if a["intent"] == "list_count" and (kind == "class" or "class" in question.lower()):
            return self._class_list(question, a, language)
        about_enum = "enum" in question.lower() and bool(a["classes"])
        chunks = self._filtered(language, kind)
        semantic = self._vector(chunks, question, 2 * k, min(threshold, 0.3) if about_enum else threshold)
        words = a["keywords"] + a["expanded"][: V.EXPANSIONS_SEARCHED]
        found = search.fuse(semantic, search.keyword_search(chunks, words, k) if hybrid else search.keyword_search(chunks, [], k), k)
        found = checkpointed(found)
        direct = self.chunks.filter(F.col("class_name").isin(*a["classes"]) & (F.col("chunk_type") == "class")).orderBy(F.array_position(F.array(*(F.lit(c) for c in a["classes"])), F.col("class_name")), "id").limit(1) if a["classes"] else None
        direct = direct if direct is not None and not direct.isEmpty() else None
        if a["classes"] and direct is None:
            exact = F.col("class_name").isin(*a["classes"])
            partial = F.exists(F.array(*(F.lit(c) for c in a["classes"])), lambda c: F.contains("class_name", c))
            named = found.join(self.chunks.select("id", "class_name"), "id")
            found = search.boost(search.boost(named, F.coalesce(partial & ~exact, F.lit(False)), 1.3).select("id", "score", "rank", "class_name"), F.coalesce(exact, F.lit(False)))
            found = found.select("id", "score", "rank")
        if about_enum:
            inner = checkpointed(reduce(DataFrame.unionByName, [self._enums_of(c, language) for c in a["classes"]]))
            if not inner.isEmpty():
                found, direct = search.pin(found, inner), None
        if direct is not None:
            if a["intent"] == "schema":
                every = store.chunks_of_class(self.chunks, direct.first()["class_name"]).select("id", F.col("start_line").alias("place"))
                found = search.pin(found.limit(0), every)
            else:
                found = search.pin(found, direct)
        sources = checkpointed(found.join(self.chunks.drop("embedding"), "id"))
        dependencies = self.dependencies(sources, max_dependencies) if with_dependencies else None
        context = self._context(sources, dependencies)
        return self._answered(question, a, sources, dependencies, context, self._prompt(question, context))

    def dependencies(self, sources: DataFrame, per_chunk: int = 3) -> DataFrame:
        """Classes that the first references of the sources name, by the place of the first mention."""
        refs = sources.select("id", F.posexplode("references").alias("pos", "name"))
        classes = self.chunks.filter("chunk_type = 'class'").groupBy(F.col("class_name").alias("name")).agg(F.min("id").alias("class_id"))
        found = search.dependencies(sources.select("id", "rank"), refs, classes, per_chunk)
        return found.withColumnRenamed("class_id", "id").join(self.chunks.drop("embedding"), "id")

    def class_with_context(self, name: str) -> DataFrame:
        """The class, the classes it names and the chunks that name it, with their leg."""
        refs = self.chunks.select("id", F.posexplode("references").alias("pos", "name"))
        classes = self.chunks.filter("chunk_type = 'class'").groupBy(F.col("class_name").alias("name")).agg(F.min("id").alias("class_id"))
        return search.class_context(name, refs, classes).join(self.chunks.drop("embedding"), "id")

    def template_dependencies(self, path: str) -> DataFrame:
        """Classes that the template nearest to a path refers to; keys and values of its JSON name them."""
        template = F.broadcast(self._vector(self._filtered(None, "template"), path, 1, None)).join(self.chunks, "id")
        named = template.select(F.explode(F.array_distinct(files.json_names("content"))).alias("class_name"))
        return self.chunks.filter("chunk_type = 'class'").drop("embedding").join(bounded(checkpointed(named)), "class_name")

    def _class_list(self, question: str, a: dict, language: str | None) -> Answer:
        """All classes as sources; the prompt has their number and the first LISTED of them by name."""
        classes = store.list_classes(self.chunks.drop("embedding"), language)
        n = classes.count()
        name = F.coalesce("class_name", "file_path")
        line = F.concat(name, F.lit(" ("), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"), F.lit(")"))
        page = [r[0] for r in classes.orderBy(name, "file_path", "id").limit(LISTED).select(line).collect()]
        context = "\n".join(f"{i}. {x}" for i, x in enumerate(page, 1)) + (f"\n... and {n - LISTED} more" if n > LISTED else "")
        prompt = f"All {n} indexed classes:\n\n{context}\n\nQuestion: {question}\nAnswer with the whole list."
        return self._answered(question, a, classes, None, context, prompt)

    def _context(self, sources: DataFrame, dependencies: DataFrame | None) -> str:
        place = F.concat("file_path", F.lit(":"), F.coalesce(F.col("start_line").cast("string"), F.lit("")), F.lit("-"), F.coalesce(F.col("end_line").cast("string"), F.lit("")))
        body = F.concat(F.lit("\n```"), "language", F.lit("\n"), "content", F.lit("\n```"))
        named = F.when(F.size("references") > 0, F.concat(F.lit("\nreferences: "), F.array_join(F.slice("references", 1, 5), ", "))).otherwise("")
        part = F.concat(F.lit("Snippet "), F.col("rank").cast("string"), F.lit(": "), place, F.coalesce(F.concat(F.lit("\n"), "documentation"), F.lit("")), named, body)
        out = search.context(sources, part).first()[0]
        if dependencies is not None:
            ranked = dependencies.select("*", (F.col("source_rank") * 1000 + F.col("pos")).alias("rank"))
            more = search.context(ranked, F.concat(F.lit("Dependency: "), F.coalesce("class_name", "file_path"), F.lit(" at "), place, body)).first()[0]
            out = f"{out}\n\n{more}" if more else out
        return out

    def _prompt(self, question: str, context: str) -> str:
        if len(context.strip()) < 100:
            return f"Question: {question}\nNothing in the index matches. Say that it was not found; do not invent code."
        return f"Snippets:\n\n{context}\n\nQuestion: {question}\nAnswer from the snippets, in their language and style, with paths and lines."

    def _answered(self, question, a, sources, dependencies, context, prompt) -> Answer:
        return Answer(question, a, sources, dependencies, context, prompt, self.generate(f"{SYSTEM_PROMPT}\n\n{prompt}") if self.generate else None)


class Conversation:
    """Questions with the last turns in front; at most 2 * max_history turns are kept."""

    def __init__(self, retriever: Retriever, max_history: int = 10):
        self.retriever, self.max_history, self.turns = retriever, max_history, []

    def ask(self, question: str, **options) -> Answer:
        shown = "\n".join(f"{role}: {text[: V.HISTORY_CHARS]}..." for role, text in self.turns[-V.HISTORY_SHOWN :])
        asked = f"Previous conversation:\n{shown}\n\nCurrent question: {question}" if shown else question
        answer = self.retriever.query(asked, **options)
        self.turns = [*self.turns, ("user", question), ("assistant", answer.answer or "")][-2 * self.max_history :]
        return answer

    def clear(self) -> None:
        self.turns = []


class Session(Conversation):
    """A conversation where a question about classes goes past the history, to classes alone, with more results."""

    def ask(self, question: str, top_k: int | None = None, language: str | None = None, **options) -> Answer | None:
        if not question.strip():
            return None
        if "class" not in question.lower():
            return super().ask(question, top_k=top_k, **options)
        named = self.retriever.chunks.sparkSession.createDataFrame([(question,)], "q string").select(analyze.asked_language(F.col("q"))).first()[0]
        return self.retriever.query(question, top_k=max(3 * (top_k or 10), 20), language=language or named, chunk_type="class", **options)


def shown(chunks: DataFrame, kind: str = "sources") -> DataFrame:
    """Result rows for a reader: name, place and the beginning of the content."""
    most = PREVIEWS[kind]
    place = F.concat("file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit("-"), F.col("end_line").cast("string"))
    preview = F.concat(F.left("content", F.lit(most)), F.when(F.length("content") > most, "...").otherwise(""))
    first = [c for c in ("rank", "score", "leg") if c in chunks.columns]
    return chunks.select(*first, F.coalesce("class_name", "file_path").alias("name"), "chunk_type", place.alias("place"), "references", preview.alias("preview"))


def dispatch(chunks: DataFrame, question: str | None = None, class_name: str | None = None, template: str | None = None, retrieve_only: bool = False, top_k: int | None = None, language: str | None = None, with_dependencies: bool = False, **retriever):
    """One request, by the first of these that is given: a class with its context, the classes that a template refers to, or a
    question (an Answer; retrieve_only: the chunks with their similarity). Without top_k the intent of the question decides how
    many. An empty index is an error."""
    if chunks.isEmpty():
        raise ValueError("nothing is indexed yet")
    r = Retriever(chunks, **retriever)
    if class_name:
        return shown(r.class_with_context(class_name))
    if template:
        return shown(r.template_dependencies(template), "templates")
    if not question:
        raise ValueError("give a question, a class name or a template")
    if retrieve_only:
        return shown(r.retrieve_only(question, top_k or 10, language).withColumnRenamed("similarity", "score").join(chunks.drop("embedding"), "id"))
    listing = chunks.sparkSession.createDataFrame([(question,)], "q string").select(analyze.asks_for_class_list(F.col("q")), analyze.asked_language(F.col("q"))).first()
    if listing[0]:
        return r._class_list(question, r.analyse(question), language or listing[1])
    return r.query(question, top_k=top_k, language=language, include_dependencies=True if with_dependencies else None)


def prepare(spark: SparkSession, folder: str, out: str, strategy: str, share: float = 0.1, most: int | None = 500) -> DataFrame:
    """Examples of a strategy from the Java files of a tree, split and written as JSON lines; gives the counts by split."""
    types = code.java_types(files.relative(files.java_files(spark, folder), folder), max_lines=500).filter("parent = -1")
    rows = checkpointed(training.split(checkpointed(strategies.convert(types, strategy)), "id", share, most))
    for part in ("train", "validation"):
        files.write_jsonl(training.shuffled(rows.filter(F.col("split") == part), "id", part), "line", f"{out.rstrip('/')}/{part}")
    return rows.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


def prepare_templates(spark: SparkSession, folder: str, template_folder: str, out: str, mapping: str | None = None, synthetic: bool = True, share: float = 0.1) -> DataFrame:
    """Examples of classes with their matched templates, and inferred ones for the others; split and written as JSON lines."""
    types = code.java_types(files.relative(files.java_files(spark, folder), folder)).filter("parent = -1")
    templates = files.template_files(spark, template_folder, sub=None)
    manual = files.manual_mapping(spark, mapping) if mapping else spark.createDataFrame([], "name string, template string")
    pairs = checkpointed(training.tiered_match(types.select("name").distinct(), templates.select("template").distinct(), files.template_references(templates), manual))
    content = pairs.join(templates.select("template", F.col("text").alias("content")), "template").select("name", "content")
    chosen = types if synthetic else types.join(pairs.select("name"), "name", "left_semi")
    examples = strategies.template_generation(chosen, content)
    key = F.left(F.sha2(F.concat_ws(":", "path", "name", "part", "model_response"), 256), F.lit(16))
    rows = examples.select(key.alias("id"), "part", training.chat_record(F.lit(strategies.INSTRUCTIONS["template_generation"]), F.col("user_prompt"), F.col("model_response")).alias("line"))
    rows = checkpointed(training.split(checkpointed(rows), "id", share, None))
    for part in ("train", "validation"):
        files.write_jsonl(training.shuffled(rows.filter(F.col("split") == part), "id", part), "line", f"{out.rstrip('/')}/{part}")
    return rows.groupBy("split", "part").agg(F.count(F.lit(1)).alias("n"))


def evaluate(prompts: DataFrame, generate: Callable[[str], str]) -> DataFrame:
    """prompts: prompt, expected. Adds actual, success, similarity; an error of the generator is a failure with its text."""

    def run(batches):
        for b in batches:
            rows = []
            for p in b["prompt"]:
                try:
                    rows.append((generate(p), None))
                except Exception as error:
                    rows.append((None, str(error)))
            yield b.assign(actual=[r[0] for r in rows], error=[r[1] for r in rows])

    answered = prompts.select("prompt", "expected").mapInPandas(run, "prompt string, expected string, actual string, error string")
    return training.evaluate(answered)
