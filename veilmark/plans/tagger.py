"""A tagger of notes: sentence rows to a scoring model and its vectors back to notes, for prediction and evaluation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilmark.functions import text as X
from veilmark.functions.labels import default_tags, label_ids, tag
from veilmark.functions.schema import NER_TYPES, label_vocabulary
from veilmark.operators import context, scores
from veilmark.operators.entities import gather_notes
from veilmark.operators.split import first_n, shuffle
from veilmark.plans.pipeline import evaluate
from veilmark.sources.notes import RunConfig

#: A model: sentence rows (tokens, labels, ..) with a column ``scores`` of a vector for each token, in the order of the vocabulary.
Model = Callable[[DataFrame], DataFrame]


def rule_model(tags: list[str], notation: str) -> Model:
    """A model that is sure of what the rules say of each token on its own, for runs without a trained one."""

    def vector(t: Column) -> Column:
        label = X.rule_label(t)
        own = F.when(label.isNull(), "O").otherwise(tag(F.lit(1), F.lit(1), label, notation))
        return F.transform(F.array(*[F.lit(x) for x in tags]), lambda x: F.when(x == own, 4.0).otherwise(0.0))

    return lambda rows: rows.withColumn("scores", F.transform("tokens", vector))


class Tagger:
    """Notes (note_id, text, and spans to train or evaluate on) by split, tagged by a model.

    ``load`` gives the splits; ``set_train``, ``set_eval`` and ``set_predict`` choose one, the first ``limit`` notes of it if asked, in an order that ``seed`` sets; ``predict`` and ``evaluate`` work on
    what was set.  Fitting a model is the caller's business: ``train_rows`` are what it learns from."""

    def __init__(self, config: RunConfig, model: Model | None = None):
        self.config = config
        self.types = config.ner_types or NER_TYPES
        self.tags = label_vocabulary(config.notation, self.types)
        self.model = model or rule_model(self.tags, config.notation)
        self._splits: dict[str, DataFrame] = {}
        self._set: dict[str, DataFrame] = {}

    def load(self, splits: dict[str, DataFrame]) -> Tagger:
        self._splits = dict(splits)
        return self

    def _choose(self, use: str, split: str, limit: int | None, seed: int | None) -> Tagger:
        if split not in self._splits:
            raise ValueError(f"no split {split!r}; there are {sorted(self._splits)}")
        notes = self._splits[split]
        if seed is not None:
            notes = shuffle(notes, "note_id", seed)
        order = "note_id" if seed is None else "shuffle_key"
        self._set[use] = first_n(notes, order, limit) if limit else notes
        return self

    def set_train(self, split: str = "train", limit: int | None = None, seed: int | None = 41) -> Tagger:
        return self._choose("train", split, limit, seed)

    def set_eval(self, split: str = "validation", limit: int | None = None, seed: int | None = 41) -> Tagger:
        return self._choose("eval", split, limit, seed)

    def set_predict(self, split: str = "test", limit: int | None = None) -> Tagger:
        return self._choose("predict", split, limit, None)

    def _notes(self, use: str) -> DataFrame:
        if use not in self._set:
            raise ValueError(f"set_{use} first")
        return self._set[use]

    def rows(self, use: str) -> DataFrame:
        """Sentence rows of what was set: by spans to train and evaluate, O to predict; context is NA."""
        c, notes = self.config, self._notes(use)
        mode = "predict" if use == "predict" else "train"
        t = X.note_tokens(notes, ["note_id"])
        spans = None
        if mode == "train":
            t = t.join(notes.select("note_id", "spans"), "note_id")
            spans = F.col("spans")
        tagged = F.zip_with("tokens", default_tags(F.col("tokens"), mode, c.notation, spans), lambda x, y: x.withField("tag", y))
        return context.sentence_rows(t.withColumn("tokens", tagged), ["note_id"], c.max_tokens, c.chunk, c.max_prev, c.max_next)

    def train_rows(self) -> DataFrame:
        return self.rows("train")

    def predict(self, use: str = "predict") -> DataFrame:
        """(note_id, tokens, labels, predictions): the model's vectors decoded, without context, put together by note."""
        ids = label_ids(self.tags)
        number = F.create_map(*[F.lit(x) for kv in ({context.CONTEXT_LABEL: scores.IGNORED} | ids).items() for x in kv])
        rows = self.model(self.rows(use)).withColumn("labels", F.transform("labels", lambda y: F.element_at(number, y)))
        out = scores.decoded(rows, self.config.post_process, self.tags, self.config.threshold, self.config.notation, "scores", "labels")
        sentences = out.select("note_id", "start", F.col("current_sent_info").alias("tokens"), "labels", F.col("scores").alias("predictions"))
        return gather_notes(sentences, sentences.select("note_id").distinct())

    def evaluate(self, maps: dict[str, dict[str, str]] | None = None, mode: str = "strict") -> DataFrame:
        """(name, value): metrics of what ``set_eval`` set, as tagged and under projections of types."""
        if self.config.post_process == "logits":
            raise ValueError("vectors can't be evaluated")
        notes = self._notes("eval")
        zipped = F.arrays_zip(F.col("tokens").alias("t"), F.col("labels").alias("truth"), F.col("predictions").alias("tag"))
        tags = self.predict("eval").select("note_id", F.posexplode(zipped).alias("idx", "x")).select("note_id", "idx", "x.t.start", "x.t.end", "x.truth", "x.tag")
        gold = notes.select("note_id", F.inline("spans")).select("note_id", "label", *[F.col(c).cast("long").alias(c) for c in ("start", "end")])
        return evaluate(gold, tags, ["note_id"], self.config.notation, maps, mode)
