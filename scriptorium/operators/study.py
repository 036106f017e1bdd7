"""Study material from documents: definitions, lists, acronyms, facts, terms, question banks, cards, quizzes, notes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sentences as Z
from ..functions import text as T
from ..functions import words as W
from ..functions.counts import rows
from . import retrieval as R


def paragraphs(pages: DataFrame) -> DataFrame:
    """``doc_id, page, para, text``: a line that begins in lower case or with a parenthesis
    continues one that doesn't end a sentence."""
    flat = pages.select("doc_id", "page", F.posexplode(F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"\n+"), T.squash), lambda x: x != "")).alias("i", "line"))
    per = Window.partitionBy("doc_id", "page").orderBy("i")
    before = F.lag("line").over(per)
    starts = F.when(before.isNotNull() & ~before.rlike("[.!?:]$") & F.col("line").rlike(r"^[\p{Ll}(]"), 0).otherwise(1)
    numbered = flat.withColumn("new", starts).withColumn("para", F.sum("new").over(per) - 1)
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "line"))), lambda x: x["line"])
    return numbered.groupBy("doc_id", "page", "para").agg(F.array_join(ordered, " ").alias("text"))


def facts(pages: DataFrame, placed: bool = False) -> DataFrame:
    """``doc_id, page, text``: sentences of 5 to 70 words, mostly letters, each once a document; with
    ``placed`` also ``para, i``, their place on the page."""
    found = pages.select("doc_id", "page", Z.of_page(F.col("text")).alias("f")).select("doc_id", "page", F.inline_outer(F.transform("f", lambda x: F.struct(x["para"].alias("para"), x["i"].alias("i"), x["text"].alias("text")))))
    good = found.where("text IS NOT NULL")
    first = good.groupBy("doc_id", F.lower("text").alias("k")).agg(F.min(F.struct("page", "para", "i", "text")).alias("f"))
    return first.select("doc_id", "f.page", "f.text", *(["f.para", "f.i"] if placed else []))


def definitions(docs: DataFrame) -> DataFrame:
    """``doc_id, sent_idx, subject``: what a sentence defines; weak subjects are left out."""
    subject = F.regexp_extract("text", W.SUBJECT, 1)
    return R.sentences(docs).withColumn("subject", F.lower(subject)).where((F.length("subject") > 3) & ~F.col("subject").rlike(W.WEAK_SUBJECT)).select("doc_id", "sent_idx", "subject")


def list_sentences(docs: DataFrame, least: int = 3, most: int = 8) -> DataFrame:
    """``doc_id, sent_idx, subject, items``: sentences that list things."""
    found = R.sentences(docs).withColumns({"subject": F.lower(F.regexp_extract("text", W.LIST, 1)), "rest": F.regexp_extract("text", W.LIST, 2)})
    listed = found.where("subject <> ''").withColumn("items", T.list_items(F.col("rest")))
    return listed.where(F.size("items").between(least, most) & F.contains("rest", F.lit(","))).select("doc_id", "sent_idx", "subject", F.size("items").cast("long").alias("items"))


def expansions(docs: DataFrame) -> DataFrame:
    """``doc_id, acronym, expansion`` of sentences that spell an acronym out."""
    found = R.sentences(docs).select("doc_id", F.regexp_extract("text", W.SPELLED_OUT, 1).alias("acronym"), F.regexp_extract("text", W.SPELLED_OUT, 2).alias("expansion"))
    return found.where("acronym <> ''").dropDuplicates(["doc_id", "acronym"])


def term_facts(facts_: DataFrame, terms: DataFrame) -> DataFrame:
    """``facts_`` with each ``term`` of ``terms(doc_id, term)`` that it mentions: the facts of a document meet
    its terms within the join, so that only mentions leave it. The first four words of a term find it in
    the fact's words, and the whole term decides."""
    said = facts_.withColumn("said", T.padded(F.col("text")))
    words = T.tokenize(F.col("term"))
    keyed = terms.where(F.size(words) > 0).withColumn("run", F.concat(F.lit(" "), F.array_join(F.slice(words, 1, 4), " "), F.lit(" ")))
    return said.join(keyed, "doc_id").where(F.contains("said", F.col("run")) & T.mentions(F.col("text"), F.col("term"))).drop("said", "run")


def term_mentions(facts_: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, term, facts``: in how many facts of its document each of ``terms(doc_id, term)``,
    of one to four words, stands as whole words. The facts of a document meet its terms within
    the join; no run of words is a row."""
    said = facts_.select("doc_id", T.padded(F.col("text")).alias("said"))
    words = T.tokenize(F.col("term"))
    wanted = terms.where(F.size(words).between(1, 4)).select("doc_id", F.array_join(words, " ").alias("term")).distinct()
    found = said.join(wanted, "doc_id").where(F.contains("said", F.concat(F.lit(" "), "term", F.lit(" "))))
    return found.groupBy("doc_id", "term").agg(F.count("*").alias("facts"))


def important(rows: DataFrame, by: str, weight: str, tie: str, share: float = 0.4) -> DataFrame:
    """``rows`` with ``important``: the best ``share`` of each group (at least one), by weight and then by place."""
    per = Window.partitionBy(by)
    rank = F.row_number().over(per.orderBy(F.desc(weight), tie))
    return rows.withColumn("important", rank <= F.greatest(F.lit(1), T.js_round(F.count("*").over(per) * F.lit(share))))


def could_ask(sentence: str) -> bool:
    """A sentence that one of the bank's patterns may fit."""
    return "stands for" in sentence or any(Z.fit(sentence, p).match(sentence) for p in (W.SUBJECT, W.LIST, W.PURPOSE))


def _could_ask(page: str | None) -> list[tuple[int, str, str | None]]:
    """``sent_idx, text, after``: the sentences of a page that one of the bank's patterns fits, each with the next one."""
    said = Z.sentences(page)
    return [(i, x, said[i + 1] if i + 1 < len(said) else None) for i, x in enumerate(said) if could_ask(x)]


def question_bank(docs: DataFrame, most: int = 16, asks: DataFrame | None = None) -> DataFrame:
    """``doc_id, n, type, question, answer, weight, important``: two-mark questions from a
    document's own sentences, in reading order. A sentence gives the first kind that fits:
    a spelled-out acronym, a list, a definition (with the next sentence of its page), a purpose.
    ``asks(doc_id, page, sent_idx, text, after)``: the sentences that may be asked, if they are known."""
    from ..sources.tables import pages

    order = Window.partitionBy("doc_id").orderBy("page", "sent_idx")
    # a sentence gets the next one within its page's row: only questions are shuffled
    found = pages(docs).select("doc_id", "page", rows(_could_ask, "array<struct<sent_idx:int,text:string,after:string>>", "text").alias("s"))
    s = found.select("doc_id", "page", F.inline_outer("s")).where("sent_idx IS NOT NULL") if asks is None else asks
    acronym = F.when(F.contains(F.col("text"), F.lit("stands for")), F.regexp_extract("text", W.SPELLED_OUT, 1)).otherwise("")  # most sentences are spared the search
    subject = F.regexp_extract("text", W.SUBJECT, 1)
    lister, rest, purpose = F.regexp_extract("text", W.LIST, 1), F.regexp_extract("text", W.LIST, 2), F.regexp_extract("text", W.PURPOSE, 1)
    strong = lambda c: (F.length(c) > 3) & ~c.rlike(W.WEAK_SUBJECT)
    listed = strong(lister) & F.contains(rest, F.lit(",")) & F.size(T.list_items(rest)).between(3, 8)
    kind = (
        F.when(acronym != "", "Full form").when(listed, "List / State")
        .when(strong(subject) & (T.word_count(F.col("text")) >= 6), "Definition").when(strong(purpose), "Purpose")
    )
    asked = (
        F.when(F.col("type") == "Full form", F.concat(F.lit("What does "), acronym, F.lit(" stand for?")))
        .when(F.col("type") == "List / State", F.concat(F.lit("List what "), F.lower(lister), F.lit(" includes.")))
        .when(F.col("type") == "Definition", F.concat(F.lit("Define "), F.lower(subject), F.lit(".")))
        .otherwise(F.concat(F.lit("State the purpose of "), F.lower(purpose), F.lit(".")))
    )
    answer = F.when((F.col("type") == "Definition") & F.col("after").isNotNull(), F.concat_ws(" ", "text", "after")).otherwise(F.col("text"))
    found = s.withColumn("type", kind).where("type IS NOT NULL").withColumns({"question": asked, "answer": answer})
    once = found.withColumn("r", F.row_number().over(Window.partitionBy("doc_id", "question").orderBy("page", "sent_idx"))).where("r = 1")
    capped = once.withColumn("n", F.row_number().over(order)).where(F.col("n") <= most)
    weighed = capped.select("doc_id", "n", "type", "question", "answer", F.size(F.array_distinct(T.content_terms(F.col("answer")))).alias("weight"))
    return important(weighed, "doc_id", "weight", "n")


def flashcards(bank: DataFrame, most: int = 420) -> DataFrame:
    """``doc_id, n, prompt, answer``: questions without code, plain and clipped."""
    return bank.where(~F.contains("question", F.lit("```"))).select("doc_id", "n", T.plain_text(F.col("question")).alias("prompt"), T.clip_words(T.plain_text(F.col("answer")), most).alias("answer"))


def bank_markdown(bank: DataFrame, types: tuple[str, ...] = ("Definition", "List / State", "Full form", "Purpose", "Code")) -> DataFrame:
    """``doc_id, markdown``: questions grouped by type in the order of ``types``, unknown ones last."""
    place = F.coalesce(F.nullif(F.array_position(T.strings(types), F.col("type")), F.lit(0)), F.lit(99))
    piece = F.concat(F.lit("**"), "question", F.lit("**\n\n"), "answer")
    each = bank.groupBy("doc_id", "type").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", piece.alias("p")))), lambda x: x["p"]), "\n\n").alias("body"))
    block = F.concat(F.lit("## "), "type", F.lit("\n\n"), "body")
    return each.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(place.alias("k"), "type", block.alias("b")))), lambda x: x["b"]), "\n\n").alias("markdown"))


def notes(docs: DataFrame) -> DataFrame:
    """``doc_id, markdown``: title, overview of three sentences, key terms, and bank."""
    title = docs.select("doc_id", F.coalesce(F.nullif(T.heading_of(F.col("text")), F.lit("")), F.lit("Notes")).alias("title"))
    line = F.concat(F.lit("- "), "text")
    overview = R.summarize(docs, 3).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("sent_idx", line.alias("p")))), lambda x: x["p"]), "\n").alias("overview"))
    terms = R.keywords(docs).groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("terms"))
    bank = bank_markdown(question_bank(docs))
    joined = title.join(overview, "doc_id", "left").join(terms, "doc_id", "left").join(bank, "doc_id", "left")
    parts = F.array_compact(F.array(
        F.concat(F.lit("# "), "title"), F.concat(F.lit("## Overview\n\n"), "overview"), F.concat(F.lit("## Key terms\n\n"), "terms"), F.concat(F.lit("## Questions\n\n"), "markdown"),
    ))
    return joined.select("doc_id", F.array_join(parts, "\n\n").alias("markdown"))


def quiz_terms(docs: DataFrame, most: int = 80) -> DataFrame:
    """``doc_id, term, shown, score, n``: what a quiz can ask for (``quiz_terms.chosen``)."""
    from . import quiz_terms as Q

    return Q.quiz_terms(docs, most)


def quiz_sets(docs: DataFrame, seed: int = 1, sets: int = 3, each: int = 10) -> DataFrame:
    """``doc_id, set_no, place, term, question, options, answer``: blanks to fill in, at most two a
    fact, in an order that follows from the seed alone; three other terms of the document,
    nearest in word count, are the wrong options."""
    from . import quiz_terms as Q

    own = docs.where("doc_id IS NOT NULL").select("doc_id", Q.mentions(F.col("text")).alias("m")).select("doc_id", "m.*")
    mixed = F.transform("pairs", lambda p: F.xxhash64(F.lit(seed), "doc_id", F.get("terms", p["t"]), F.get("facts", p["f"])))
    picked = own.select("doc_id", "terms", "words", "facts", Q.dealt(F.col("pairs"), mixed, sets * each).alias("dealt"))
    # the terms and texts of what is asked leave the row, no other fact does
    asked = F.transform("dealt", lambda d, i: F.struct(i.alias("n"), F.get("terms", d["t"]).alias("term"), F.get("words", d["t"]).alias("size"), F.get("facts", d["f"]).alias("text")))
    dealt = picked.select("doc_id", F.arrays_zip("terms", "words").alias("others"), F.inline_outer(asked)).where("n IS NOT NULL")
    apart = lambda x: ~F.contains(x["terms"], F.col("term")) & ~F.contains(F.col("term"), x["terms"])
    near = lambda x: F.struct(F.abs(x["words"] - F.col("size")).alias("d"), F.xxhash64(F.lit(seed), x["terms"], "n").alias("h"), x["terms"].alias("o"))
    nearest = F.slice(F.sort_array(F.transform(F.filter("others", apart), near)), 1, 3)  # at most 80 terms a document
    dealt = dealt.withColumn("wrong", F.transform(nearest, lambda x: x["o"])).where(F.size("wrong") == 3)
    options = F.transform(F.array_sort(F.transform(F.concat("wrong", F.array("term")), lambda o: F.struct(F.xxhash64(F.lit(seed), o, F.col("n")).alias("h"), o.alias("o")))), lambda x: x["o"])
    return dealt.withColumn("options", options).select(
        "doc_id", F.floor(F.col("n") / each).cast("int").alias("set_no"), (F.col("n") % each).alias("place"), "term",
        T.blank_out(F.col("text"), F.col("term")).alias("question"), "options", (F.array_position("options", F.col("term")) - 1).cast("int").alias("answer"),
    )


def grade(kind: Column, answer: Column, response: Column) -> Column:
    """Points of one answer ``array``: for a matching question the share of right places,
    otherwise all or nothing; no response is nothing."""
    right = F.size(F.filter(F.arrays_zip(answer.alias("a"), response.alias("r")), lambda x: x["a"].eqNullSafe(x["r"]) & x["a"].isNotNull()))
    return F.when(response.isNull(), 0.0).when(kind == "match", F.try_divide(right, F.size(answer))).otherwise((answer == response).cast("double"))


def sectioned_topics(docs: DataFrame) -> DataFrame:
    """``doc_id, section, title, words``: a heading line starts a section; what stands before
    the first one is section 0. Each section counts one word more than it has."""
    from ..sources.tables import lines

    flat = lines(docs).where(F.col("line").rlike(r"\S"))
    order = Window.partitionBy("doc_id").orderBy("line_no")
    headed = flat.withColumn("head", T.heading_line(F.col("line")).cast("int")).withColumn("section", F.sum("head").over(order))
    title = F.min_by(F.when(F.col("head") == 1, T.tidy_title(T.strip(F.col("line")))), F.col("line_no"))
    return headed.groupBy("doc_id", "section").agg(title.alias("title"), (F.sum(F.when(F.col("head") == 0, T.word_count(F.col("line"))).otherwise(0)) + 1).alias("words"))


def compared_definitions(docs: DataFrame, shared: int = 2) -> DataFrame:
    """``doc_id, sent_idx, subject, other``: a definition and the next one of its document, where
    their sentences share at least ``shared`` stems."""
    found = definitions(docs).join(R.sentences(docs), ["doc_id", "sent_idx"])
    stems = F.array_distinct(F.transform(T.content_terms(F.col("text")), T.stem_prefix))
    order = Window.partitionBy("doc_id").orderBy("sent_idx")
    pairs = found.withColumn("stems", stems).withColumns({"other": F.lead("subject").over(order), "theirs": F.lead("stems").over(order)})
    return pairs.where((F.col("other") != F.col("subject")) & (F.size(F.array_intersect("stems", "theirs")) >= shared)).select("doc_id", "sent_idx", "subject", "other")


def head_pairs(docs: DataFrame) -> DataFrame:
    """``doc_id, head, term, other``: neighbouring key phrases, in order of appearance, that end in the same word."""
    phrases = R.keyword_candidates(docs).where("term LIKE '% %' AND weight >= 3").withColumn("head", F.element_at(F.split("term", " "), -1))
    order = Window.partitionBy("doc_id", "head").orderBy("first_pos")
    return phrases.withColumn("other", F.lead("term").over(order)).where("other IS NOT NULL").select("doc_id", "head", "term", "other")


def mention_counts(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """``doc_id, term, n``: how often each of ``terms(doc_id, term)`` stands in its document, in any casing, also inside words."""
    text, term = F.lower(F.coalesce("text", F.lit(""))), F.lower("term")
    n = (F.length(text) - F.length(F.replace(text, term, F.lit("")))) / F.length(term)
    return terms.where("term <> ''").join(docs.select("doc_id", "text"), "doc_id").select("doc_id", "term", n.cast("long").alias("n"))


def emphasised(text: Column, terms: Column) -> Column:
    """The first mention of each term of four letters and more in bold."""

    def step(done: Column, term: Column) -> Column:
        at = F.regexp_instr(done, F.concat(F.lit(r"(?iu)(?<![*\p{L}])"), T.quote(term), F.lit(r"(?![*\p{L}])")))
        bold = F.concat(F.substr(done, F.lit(1), at - 1), F.lit("**"), F.substr(done, at, F.length(term)), F.lit("**"), F.substr(done, at + F.length(term)))
        return F.when((F.length(term) < 4) | (at == 0) | F.contains(done, F.concat(F.lit("**"), term)), done).otherwise(bold)

    return F.aggregate(terms, text, step)


def term_cards(docs: DataFrame, most: int = 40) -> DataFrame:
    """``doc_id, term, prompt``: from the strongest term on, each takes its first fact (by page and
    text) that no stronger one has taken, with the term blanked out; ``most`` cards a document."""
    from . import quiz_terms as Q

    cards = docs.where("doc_id IS NOT NULL").select("doc_id", Q.cards(F.col("text"), most).alias("c")).select("doc_id", F.inline_outer("c")).where("term IS NOT NULL")
    return cards.select("doc_id", "term", T.blank_out(F.col("text"), F.col("term")).alias("prompt"))


def sentence_cards(paged: DataFrame) -> DataFrame:
    """``doc_id, page, n, prompt, answer``: a card a sentence or paragraph of ``paged(doc_id, page,
    text)``, whose prompt holds the first five words."""
    pieces = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), r"(?<=[.!?])\s+|\n{2,}"), T.strip), lambda x: F.length(x) > 0)
    prompt = F.concat(F.lit("Recall the key idea: "), F.array_join(F.slice(F.split("answer", r"\s+"), 1, 5), " "), F.lit("…"))
    return paged.select("doc_id", "page", F.posexplode(pieces).alias("n", "answer")).select("doc_id", "page", "n", prompt.alias("prompt"), "answer")
