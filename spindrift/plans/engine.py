"""The engine: index a tree, then ask about it."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spindrift.functions import text as tx
from spindrift.functions import vector as vec
from spindrift.functions.chunking import chunk_files
from spindrift.functions.golang import chunk_go, go_signals
from spindrift.operators import hybrid, incremental
from spindrift.operators.store import Store
from spindrift.operators.summary import build_summary
from spindrift.operators.topk import join_chunks, search
from spindrift.plans import prompts
from spindrift.plans.provider import Provider, embed_column
from spindrift.schemas import IndexStatus, Mode
from spindrift.session import over_batches, ship
from spindrift.sources import files as fs
from spindrift.sources import ignore
from spindrift.sources.config import Config
from spindrift.sources.web import answer_context, web_pages
from spindrift.streaming import memory as mem


@dataclass
class Options:
    """How one request is answered. k and mmr, where set, go before mode."""

    mode: Mode = Mode.BALANCED
    k: int | None = None
    mmr: bool | None = None
    system: str = ""
    structured: bool = False
    handlers: tuple[Callable[[str], None], ...] = ()
    web_pages: DataFrame | None = None
    web: int = 0

    def retrieval(self) -> tuple[int, bool]:
        k, mmr = Mode(self.mode).settings()
        return (k if self.k is None else self.k), (mmr if self.mmr is None else self.mmr)


def index_items(files: DataFrame, provider: Provider) -> DataFrame:
    """Chunks with normalised vectors; chunks that can't be embedded are left out."""
    chunks = chunk_files(files)
    embedded = embed_column(chunks, provider).where("error is null")
    return embedded.select(F.col("path").alias("file_path"), "symbol", "kind", "start_line", "end_line", F.col("text").alias("content"), vec.normalize(F.col("embedding")).alias("embedding"))


def file_signals(files: DataFrame, include_local: bool = True) -> DataFrame:
    """(path, signals) of every file."""
    ship(files.sparkSession)
    go = over_batches(lambda s: go_signals(s, include_local), "string")
    source = F.col("content").cast("string")
    return files.select("path", F.when(tx.extension(F.col("path")) == ".go", go(source)).otherwise(tx.text_signals(source)).alias("signals"))


class Engine:
    def __init__(self, spark: SparkSession, config: Config, provider: Provider, get: Callable[[str], str] | None = None):
        """get: gives a url's page, for web searches."""
        self.spark, self.config, self.provider, self.get = spark, config, provider, get
        self.store = Store(spark, config.store)

    # --- index
    def index(self) -> int:
        """Build the index anew; number of chunks. A tree without files leaves the old one."""
        files = fs.scan(self.spark, self.config.root, self.config.extensions, self.config.ignore)
        if files.isEmpty():
            return 0
        summary = build_summary(files, file_signals(files))
        self.store.save(index_items(files, self.provider), self.config.root, self.config.hash, summary)
        return self.store.items().count()

    def refresh(self, progress: Callable[[int, int], None] | None = None) -> incremental.Refreshed:
        """Bring the index up to date: only files that are new or changed are chunked and embedded, those that are gone are left out.
        An index of other settings is built anew. progress hears (files read, files to read)."""
        config = self.config
        rules = ignore.load(self.spark, config.root, config.ignore)
        listed = fs.listing(self.spark, config.root, rules).where(fs.is_indexed(config.extensions) & ~ignore.ignored(F.col("path"), F.lit(False), rules))
        if self.status() != IndexStatus.OK:
            self.store.replace("files", self.store.read("files").limit(0))
        read = lambda paths: fs.contents(paths, config.root)
        done = incremental.refresh(self.store, incremental.digests(read(listed)), read, lambda files: index_items(files, self.provider), progress)
        if done.changed or done.removed or self.status() != IndexStatus.OK:
            files = read(listed)
            self.store.save(incremental.items(self.store), config.root, config.hash, build_summary(files, file_signals(files)) if done.files else "")
        return done

    def ensure_index(self) -> None:
        if self.status() != IndexStatus.OK:
            self.index()

    def status(self) -> IndexStatus:
        return self.store.status(self.config.hash)

    # --- requests
    def search(self, prompt: str, **options) -> str:
        k, mmr = Options(**({"mode": Mode.FAST} | options)).retrieval()
        rows = hybrid.hybrid_search(self.store.items(), prompt, self.provider.embed, k, mmr)
        return join_chunks(rows, "content", "file_path", "start_line").first().output

    def query_prompt(self, prompt: str, **options) -> str | None:
        """The rendered prompt, or None without results."""
        o = Options(**options)
        k, mmr = o.retrieval()
        rows = hybrid.run_query(self.store.items(), prompt, self.provider.embed, k, mmr, self.store.summary(self.config.root)) if k > 0 else self.store.items().limit(0).withColumn("score", F.lit(0.0))
        chunks = self._chunks(rows)
        if not chunks:
            return None
        return prompts.render("query", prompt, system=o.system, memory=self.store.memory(), structured=o.structured, chunks=chunks)

    def query(self, prompt: str, **options) -> str:
        rendered = self.query_prompt(prompt, **options)
        if rendered is None:
            raise LookupError("no results")
        return self._finish(prompt, rendered, Options(**options))

    def ask(self, prompt: str, **options) -> str:
        o = Options(**options)
        chunks = []
        pages, most = o.web_pages, min(10, o.web)
        if pages is None and self.get is not None and most > 0:
            pages = web_pages(self.spark, prompt, most, self.get).persist()  # each page is asked for once
        if pages is not None and most > 0:
            got = answer_context(pages, prompt, most).orderBy("rank").collect()
            chunks = [{"source": r.chunk_id, "score": r.score, "text": r.text} for r in got]
        return self._finish(prompt, prompts.render("ask", prompt, system=o.system, memory=self.store.memory(), structured=o.structured, chunks=chunks), o)

    def target_prompt(self, template: str, file: str, prompt: str = "", function: str = "", lines: tuple[int, int] | None = None, **options) -> str:
        """Lines go before function, and function before file."""
        if not file:
            raise ValueError("a target needs a file")
        o = Options(**options)
        source = fs.read_file(self.spark, f"{self.config.root}/{file}")
        body = source
        if lines:
            rows = source.split("\n")
            body = "\n".join(rows[max(1, lines[0]) - 1 : min(len(rows), lines[1])])
        elif function:
            body = next((p[4] for p in chunk_go(source) or [] if p[2] == function), None)
            if body is None:
                raise LookupError(f"function {function} not found")
        k, mmr = o.retrieval()
        chunks = []
        if k >= 1:
            one = self.spark.createDataFrame([(file, source)], "path string, content string")
            signals = file_signals(one, include_local=False).first().signals
            chunks = self._chunks(hybrid.hybrid_search(self.store.items(), signals, self.provider.embed, k, mmr))
        target = {"type": "function", "name": function, "body": body} if function else {"type": "file", "name": file, "body": body}
        return prompts.render(template, prompt, system=o.system, memory=self.store.memory(), structured=o.structured, target=target, chunks=chunks)

    def explain(self, file: str, **options) -> str:
        return self._target("explain", file, {"mode": Mode.BALANCED} | options)

    def summarize(self, file: str, rag: bool = False, **options) -> str:
        return self._target("summarize", file, {"mode": Mode.BALANCED if rag else Mode.NONE} | options)

    def generate_tests(self, file: str, rag: bool = False, **options) -> str:
        return self._target(prompts.test_template(file), file, {"mode": Mode.BALANCED if rag else Mode.NONE} | options)

    def edit(self, file: str, prompt: str, rag: bool = False, **options) -> str:
        return self._target("edit", file, {"mode": Mode.BALANCED if rag else Mode.NONE, "prompt": prompt} | options)

    def fix(self, file: str, rag: bool = False, **options) -> str:
        return self._target("fix", file, {"mode": Mode.BALANCED if rag else Mode.NONE} | options)

    def refactor(self, file: str, rag: bool = False, **options) -> str:
        return self._target("refactor", file, {"mode": Mode.BALANCED if rag else Mode.NONE} | options)

    def comment(self, file: str, **options) -> str:
        return self._target("comment", file, {"mode": Mode.NONE} | options)

    # --- memory
    def flush_memory(self) -> int:
        return mem.flush(self.store, lambda x, m: self.provider.generate(prompts.memory_prompt(x.get("user_input", ""), x.get("assistant_output", ""), m)))

    def chat(self, **options) -> Chat:
        return Chat(self, Options(**({"mode": Mode.FAST} | options)))

    # ---
    def _target(self, template: str, file: str, options: dict) -> str:
        prompt = options.get("prompt", "")
        rendered = self.target_prompt(template, file, **options)
        own = {k: v for k, v in options.items() if k not in ("prompt", "function", "lines")}
        return self._finish(prompt or f"{template} {file}", rendered, Options(**own))

    def _finish(self, prompt: str, rendered: str, o: Options) -> str:
        out = self.provider.generate(rendered)
        for h in o.handlers:
            h(out)
        self.store.enqueue(mem.to_payload(prompt, out))
        return out

    @staticmethod
    def _chunks(rows: DataFrame) -> list[dict]:
        got = rows.orderBy(F.desc("score"), "file_path", "start_line").select("content", "file_path", "score").collect()  # k rows, or those of the symbols asked for
        return [{"source": r.file_path, "score": r.score, "text": r.content} for r in got]


class Chat:
    """A conversation: the history holds what was said, not the prompts that context was added to."""

    def __init__(self, engine: Engine, options: Options):
        self.engine, self.options, self.history = engine, options, []

    def send(self, message: str) -> str:
        e, (k, mmr) = self.engine, self.options.retrieval()
        chunks = e._chunks(search(e.store.items(), e.provider.embed(message), k, mmr)) if k > 0 else []
        rendered = prompts.render("chat", message, system=self.options.system, memory=e.store.memory(), chunks=chunks)
        reply = "".join(e.provider.chat([*self.history, {"role": "user", "content": rendered}]))
        self.history += [{"role": "user", "content": message}, {"role": "assistant", "content": reply}]
        e.store.enqueue(mem.to_payload(message, reply))
        return reply

    def reset(self) -> None:
        self.history = []
