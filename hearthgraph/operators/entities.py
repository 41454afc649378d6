"""People, organisations and the edges between rows: names, neighbours, dossiers, screens and repair."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..model import visible
from ..session import fits, materialize

# fixed values: cue substrings that mark an organisation name, and bare pronouns
ORG_NAME_CUES = (
    "inc|ltd|llc|corp|gmbh|company|university|institute|hospital|clinic|school|lab|biotech|tech|health|pharma|"
    "group|center|centre|systems|solutions|holdings|astar"
)
PRONOUNS = ["he", "she", "they", "him", "her", "them", "it", "we", "you", "i"]
# words that open names, as many as may travel to the texts at a time
HEADS = 100_000
# bits that tell them there
HEAD_BITS = 1 << 23
# types of rows, as many as nodes are filtered by before they are joined
KINDS = 100


def names(entities: DataFrame, aliases: DataFrame) -> DataFrame:
    """(id, name): canonical name and aliases of each entity, once each."""
    return entities.select("id", F.col("canonical_name").alias("name")).union(aliases.select("id", F.col("alias").alias("name"))).distinct()


# ------------------------------------------------------------------ tokens shared by the name joins


def _words(col: Column) -> Column:
    return F.filter(F.split(F.lower(col), r"[^\p{L}\p{N}]+"), lambda x: x != "")


def _grams(col: Column, n: Column) -> Column:
    """Code-point windows of length n over a lowercased text, told by their hash: what they find is verified."""
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(col) - n + 1, F.lit(1))), lambda i: F.xxhash64(F.substring(col, i, n))))


def _gram_keys(words: DataFrame, longest: int = 32) -> DataFrame:
    """(*scope, name, n, gram): the gram that each lowercased name is looked up by; words(*scope, name) are different, a name is not empty.

    A gram is as long as the greatest power of two that the name is long enough for, up to `longest`; of a name's grams it
    is the one that the fewest names of its scope have. Written, since it tells the lengths that texts are cut to and is
    met by the grams of these.
    """
    sizes = [1]
    while 2 * sizes[-1] <= longest:
        sizes.append(2 * sizes[-1])
    scope = [c for c in words.columns if c != "name"]
    words = words.withColumn("n", F.greatest(*[F.when(F.length("name") >= n, n) for n in sizes]))
    grams = words.withColumn("gram", F.explode(_grams(F.col("name"), F.col("n"))))
    freq = grams.groupBy(*scope, "gram").agg(F.count(F.lit(1)).alias("names"))
    key = grams.join(freq, [*scope, "gram"]).groupBy(*scope, "name").agg(F.min_by(F.struct("n", "gram"), F.struct("names", "gram")).alias("k"))
    return materialize(key.select(*scope, "name", "k.n", "k.gram"), "grams")


def _with_grams(texts: DataFrame, text: str, key: DataFrame) -> DataFrame:
    """The texts' rows once for each gram of a length that a key has."""
    used = sorted(r["n"] for r in key.select("n").distinct().collect())
    by = texts.withColumn("n", F.explode(F.array(*[F.lit(n) for n in used]).cast("array<int>"))).filter(F.length(text) >= F.col("n"))
    return by.withColumn("gram", F.explode(_grams(F.col(text), F.col("n"))))


def named_in(queries: DataFrame, lexicon: DataFrame, longest: int = 32) -> DataFrame:
    """(query_id, type, id) where the lowercased query contains a name anywhere, word boundaries or not.

    Every name is looked up through one of its own character grams: the query's grams are exploded,
    joined on the gram by equality, and the few survivors verified. A gram is as long as the greatest power of two that
    the name is long enough for, up to `longest`, so that a long name is met by little else than itself and none is missed.
    The gram chosen for a name is its rarest one, which keeps a gram shared by many names from becoming a hot key.
    """
    lex = lexicon.select("type", "id", F.lower("name").alias("name")).filter(F.length("name") > 0).distinct()
    # a name shared by many rows is looked up once
    key = _gram_keys(lex.select("name").distinct(), longest)
    q = queries.select("query_id", F.lower("query").alias("q"))
    q_grams = _with_grams(q, "q", key)
    hits = q_grams.select("query_id", "n", "gram").join(key, ["n", "gram"]).select("query_id", "name")
    found = hits.join(q, "query_id").filter(F.col("q").contains(F.col("name"))).select("query_id", "name")
    return found.join(lex, "name").select("query_id", "type", "id").distinct()


def _places(body: DataFrame, heads: DataFrame, longest: int) -> DataFrame:
    """(keys, head, before, run, opens, rest): the pieces of `ts` that open a name, each with the `longest` + 1 pieces from there on.

    A map of bits of fixed size, by a hash of the heads, tells them beside the scan; where two words share a bit, a few
    come that open none. body(*keys, ts).
    """
    bit = F.pmod(F.crc32(F.col("head").cast("binary")), F.lit(HEAD_BITS)) + 1
    bits = heads.select(bit.alias("b")).groupBy(F.bitmap_bucket_number("b").alias("at")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("b")).alias("bits"))
    size = HEAD_BITS // 8
    packed, each = bytearray(size), 4096
    for r in bits.collect():
        lo = (r["at"] - 1) * each
        packed[lo : lo + each] = r["bits"][: size - lo]
    sent = body.sparkSession.sparkContext.broadcast(bytes(packed))
    keys = [c for c in body.columns if c != "ts"]

    def found(batches):
        has = np.unpackbits(np.frombuffer(sent.value, np.uint8), bitorder="little").astype(bool)
        for batch in batches:
            flat = batch.column("ts").flatten()
            size = pc.list_value_length(batch.column("ts")).to_numpy(zero_copy_only=False).astype(np.int64)
            coded = flat.dictionary_encode()
            told = has[np.fromiter((crc32(w.encode()) % HEAD_BITS for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))]
            p = np.flatnonzero(told[coded.indices.to_numpy()])
            end = np.cumsum(size)
            row = np.searchsorted(end, p, side="right")
            i = p - (end - size)[row]
            many = np.minimum(longest + 1, size[row] - i)
            ends = np.concatenate([[0], np.cumsum(many)])
            run = flat.take(pa.array(np.repeat(p - ends[:-1], many) + np.arange(ends[-1])))
            before = pc.if_else(pa.array(i > 0), flat.take(pa.array(np.maximum(p - 1, 0))), "")
            made = [flat.take(pa.array(p)), before, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), run), pa.array(i == 1), pa.array(size[row] - i, pa.int32())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(pa.array(row)) for c in keys), *made], names=[*keys, "head", "before", "run", "opens", "rest"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in body.select(*keys).dtypes)
    return body.mapInArrow(found, f"{kinds}, head string, before string, run array<string>, opens boolean, rest int")


def known_mentions(texts: DataFrame, lexicon: DataFrame, keys: tuple[str, ...] = ("text_id",), extra: tuple[str, ...] = (), at_once: int = HEADS) -> DataFrame:
    """(keys, type, id, name): lexicon names of 3+ characters present at word boundaries of each text.

    Texts and names are cut into words and what stands between them. Each word of a text travels with as many pieces as
    the longest name has, if it opens a name at all (see _places), and meets the names that open with it by equality; the rest of a name
    is compared piece by piece in the same row. A name may begin or end with other characters: the text must have them too, and no word may
    touch them. Of an entity's names that are there the first is told: by the lexicon's column `ord` if it has one,
    then by name. `extra` columns of the lexicon come with it.

    The words that open a name and occur are counted, and travel to the texts, about `at_once` at a time: whatever
    Spark thinks of their table's size, a word that opens no name never leaves the scan.
    """
    word = r"^[\p{L}\p{N}]"
    cut = lambda c: F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0))
    ord_ = F.col("ord") if "ord" in lexicon.columns else F.lit(0)
    lex = lexicon.filter(F.length("name") >= 3).select("type", "id", ord_.alias("ord"), "name", *extra, cut("name").alias("t")).distinct()
    outer = lambda c: F.coalesce(F.when(~c.rlike(word), c), F.lit(""))
    lex = lex.withColumn("lead", outer(F.col("t")[0])).withColumn("trail", F.when(F.size("t") > 1, outer(F.element_at("t", -1))).otherwise(""))
    skip = F.when(F.col("lead") != "", 1).otherwise(0)
    lex = lex.withColumn("core", F.slice("t", skip + 1, F.greatest(F.size("t") - skip - F.when(F.col("trail") != "", 1).otherwise(0), F.lit(0)))).drop("t")
    # written, since three branches read it and its size then tells Spark how to join
    lex = materialize(lex.filter(F.size("core") > 0).withColumn("head", F.col("core")[0]).withColumn("n", F.size("core")), "lexicon")
    longest = lex.agg(F.coalesce(F.max("n"), F.lit(1)).alias("n")).first()["n"]
    body = texts.select(*keys, cut("text").alias("ts")).filter(F.size("ts") > 0)
    # the different words of the texts say which heads occur: a set no larger than the lexicon, known before any run is moved
    said = texts.select(F.explode_outer(F.regexp_extract_all(F.lower("text"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("head")).filter(F.col("head").isNotNull()).distinct()
    heads = materialize(lex.select("head").distinct().join(said, "head", "left_semi"), "heads")
    shards = 1 if fits(heads, at_once) else -(-heads.count() // at_once)
    shard = lambda i: heads if shards == 1 else heads.filter(F.pmod(F.xxhash64("head"), F.lit(shards)) == i)
    at = _places(body, heads, longest)
    opening = reduce(DataFrame.unionByName, [at.join(F.broadcast(shard(i)), "head", "left_semi") for i in range(shards)])
    hits = opening.join(lex.join(heads, "head", "left_semi"), "head")
    after = F.coalesce(F.get("run", F.col("n")), F.lit(""))
    same = F.slice("run", F.lit(1), F.col("n")) == F.col("core")
    # an outer character that fills the whole gap would touch the next word, unless the text ends there
    led = (F.col("lead") == "") | (F.col("before").endswith(F.col("lead")) & ((F.col("before") != F.col("lead")) | F.col("opens")))
    trailed = (F.col("trail") == "") | (after.startswith(F.col("trail")) & ((after != F.col("trail")) | (F.col("rest") == F.col("n") + 1)))
    named = hits.filter(same & led & trailed).groupBy(*keys, "type", "id").agg(F.min(F.struct("ord", "name", *extra)).alias("f"))
    return named.select(*keys, "type", "id", "f.name", *[F.col(f"f.{c}") for c in extra])


def resolve(asked: DataFrame, people_names: DataFrame, org_names: DataFrame) -> DataFrame:
    """(name) -> (name, type, id): case-folded equality, person before organisation, smallest id first."""
    both = people_names.select(F.lower("name").alias("low"), F.lit(0).alias("o"), F.lit("person").alias("type"), "id").unionByName(
        org_names.select(F.lower("name").alias("low"), F.lit(1).alias("o"), F.lit("org").alias("type"), "id")
    )
    best = both.groupBy("low").agg(F.min_by(F.struct("type", "id"), F.struct("o", "id")).alias("r"))
    return asked.select("name", F.lower("name").alias("low")).distinct().join(best, "low").select("name", "r.type", "r.id")


# ------------------------------------------------------------------ edges


def neighbors(refs: DataFrame, edges: DataFrame, allowed: int = 1) -> DataFrame:
    """(key, type, id) one hop around each (key, type, id) in either direction, the rows themselves included."""
    e = edges.filter(visible(F.col("tier"), allowed)).select("src_type", "src_id", "dst_type", "dst_id")
    inward = (
        refs.join(e, (F.col("type") == F.col("dst_type")) & (F.col("id") == F.col("dst_id")))
        .select("key", F.col("src_type").alias("type"), F.col("src_id").alias("id"))
    )
    outward = (
        refs.join(e, (F.col("type") == F.col("src_type")) & (F.col("id") == F.col("src_id")))
        .select("key", F.col("dst_type").alias("type"), F.col("dst_id").alias("id"))
    )
    return inward.unionByName(outward).unionByName(refs.select("key", "type", "id")).distinct()


def near_pairs(pairs: DataFrame, refs: DataFrame, edges: DataFrame, kind: str, allowed: int = 1) -> DataFrame:
    """Those of the pairs (query_id, parent_id) whose row of type `kind` neighbors() finds around the refs (key, type, id) of its query.

    Starts from the pairs, so a node with any number of edges makes no pair that nobody asks for.
    """
    e = edges.filter(visible(F.col("tier"), allowed)).select("src_type", "src_id", "dst_type", "dst_id")
    p = pairs.select("query_id", "parent_id").distinct()
    at = lambda side: e.filter(F.col(f"{side}_type") == kind).withColumnRenamed(f"{side}_id", "parent_id")
    inward = p.join(at("src"), "parent_id").select("query_id", "parent_id", F.col("dst_type").alias("type"), F.col("dst_id").alias("id"))
    outward = p.join(at("dst"), "parent_id").select("query_id", "parent_id", F.col("src_type").alias("type"), F.col("src_id").alias("id"))
    itself = p.select("query_id", "parent_id", F.lit(kind).alias("type"), F.col("parent_id").alias("id"))
    named = refs.select(F.col("key").alias("query_id"), "type", "id")
    return inward.unionByName(outward).unionByName(itself).join(named, ["query_id", "type", "id"], "left_semi").select("query_id", "parent_id").distinct()


def parent_meta(refs: DataFrame, nodes: DataFrame, allowed: int = 1) -> DataFrame:
    """Attach title (120 characters) and tier to (type, id); invisible rows disappear."""
    n = nodes.filter(visible(F.col("tier"), allowed)).withColumn("title", F.substring("title", 1, 120))
    return refs.join(n, ["type", "id"])


def with_titles(edges: DataFrame, nodes: DataFrame, allowed: int = 1) -> DataFrame:
    """Titles for both endpoints; unknown or invisible rows stay untitled."""
    n = nodes.filter(visible(F.col("tier"), allowed)).select("type", "id", F.substring("title", 1, 120).alias("title"))
    s = n.select(F.col("type").alias("src_type"), F.col("id").alias("src_id"), F.col("title").alias("src_title"))
    d = n.select(F.col("type").alias("dst_type"), F.col("id").alias("dst_id"), F.col("title").alias("dst_title"))
    return edges.join(s, ["src_type", "src_id"], "left").join(d, ["dst_type", "dst_id"], "left")


def edges_around(edges: DataFrame, allowed: int = 1, limit: int = 20) -> DataFrame:
    """Both-direction edges of every node, newest first, at most `limit` each (a top-k per node)."""
    e = edges.filter(visible(F.col("tier"), allowed))
    keep = [c for c in edges.columns]
    out = e.select(F.col("src_type").alias("node_type"), F.col("src_id").alias("node_id"), *keep).unionByName(
        e.filter((F.col("src_type") != F.col("dst_type")) | (F.col("src_id") != F.col("dst_id"))).select(
            F.col("dst_type").alias("node_type"), F.col("dst_id").alias("node_id"), *keep
        )
    )
    w = Window.partitionBy("node_type", "node_id").orderBy(F.desc("created_on"), "edge_id")
    return out.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= limit)


def dedupe_edges(edges: DataFrame) -> DataFrame:
    """Among edges equal on both ends and relation keep the oldest, then the smallest id."""
    rest = [c for c in edges.columns if c not in ("src_type", "src_id", "rel", "dst_type", "dst_id")]
    return (
        edges.groupBy("src_type", "src_id", "rel", "dst_type", "dst_id")
        .agg(F.min_by(F.struct(*rest), F.struct("created_on", "edge_id")).alias("_e"))
        .select("src_type", "src_id", "rel", "dst_type", "dst_id", "_e.*")
    )


def recent_interactions(interactions: DataFrame, key: str, allowed: int = 2, limit: int = 20) -> DataFrame:
    w = Window.partitionBy(key).orderBy(F.desc("occurred_on"), F.desc("id"))
    return (
        interactions.filter(visible(F.col("tier"), allowed))
        .withColumn("rn", F.row_number().over(w))
        .filter(F.col("rn") <= limit)
    )


def relation_answers(questions: DataFrame, lexicon: DataFrame, edges: DataFrame, nodes: DataFrame, allowed: int = 1) -> DataFrame:
    """(query_id, name): titles of the rows one hop around whatever a question names."""
    # written, since three branches read it and its size then tells Spark how to join
    named = materialize(named_in(questions, lexicon).withColumnRenamed("query_id", "key"), "named")
    # written as well: the few types that are there say which nodes are read
    around = materialize(neighbors(named, edges, allowed), "around")
    kinds = [r["type"] for r in around.select("type").filter("type is not null").distinct().limit(KINDS + 1).collect()]
    if len(kinds) <= KINDS:
        nodes = nodes.filter(F.col("type").isin(kinds))
    return parent_meta(around, nodes, allowed).select(F.col("key").alias("query_id"), F.col("title").alias("name")).distinct()


def answer_check(answers: DataFrame, expected: DataFrame) -> DataFrame:
    """Per question: does every expected name occur inside one of the answers?

    An expected name meets the answers of its own question that have one of its grams (see named_in), and no more of
    them than it takes to find it: questions pool any number of names and answers, and no pair of these is made.
    """
    asked = expected.select("query_id", "expect", F.lower("expect").alias("name"))
    said = answers.select("query_id", F.lower("name").alias("said")).filter(F.col("said").isNotNull())
    key = _gram_keys(asked.select("query_id", "name").filter((F.length("name") > 0) & F.col("query_id").isNotNull()).distinct())
    at = _with_grams(said, "said", key).withColumnRenamed("query_id", "asker").withColumnsRenamed({"n": "_n", "gram": "_gram"})
    named = key.join(
        at, (F.col("query_id") == F.col("asker")) & (F.col("n") == F.col("_n")) & (F.col("gram") == F.col("_gram")) & F.col("said").contains(F.col("name")), "left_semi"
    ).select("query_id", "name")
    # an empty name is inside any answer
    blank = asked.filter(F.col("name") == "").join(said, "query_id", "left_semi").select("query_id", "name")
    found = asked.join(named.unionByName(blank).distinct(), ["query_id", "name"], "left_semi").select("query_id", "expect").distinct().withColumn("found", F.lit(1))
    return (
        expected.join(found, ["query_id", "expect"], "left")
        .groupBy("query_id")
        .agg(F.count(F.lit(1)).alias("expected"), F.count("found").alias("found"))
        .withColumn("ok", F.col("expected") == F.col("found"))
    )


# ------------------------------------------------------------------ pairs


def groups_sharing(members: DataFrame) -> DataFrame:
    """(entity, member, group_size): the distinct members of every entity that has two or more.

    Each two members of a group are a pair that shares the entity, so this says all pairs without writing them out.
    """
    m = members.select("entity", "member").distinct()
    size = m.groupBy("entity").agg(F.count(F.lit(1)).alias("group_size")).filter("group_size > 1")
    return m.join(size, "entity")


# ------------------------------------------------------------------ screens and repair


def phantom_people(people: DataFrame, aliases: DataFrame, orgs: DataFrame, org_aliases: DataFrame, interactions: DataFrame) -> DataFrame:
    """Per person: shares a name with a live organisation? shows any human signal?"""
    live = orgs.filter(~F.col("retired"))
    org_low = (
        names(live, org_aliases.join(live.select("id"), "id", "left_semi")).select(F.lower("name").alias("low")).distinct()
    )
    matched = (
        names(people, aliases).withColumn("low", F.lower("name")).join(org_low, "low", "left_semi")
        .select("id").distinct().withColumn("name_match", F.lit(True))
    )
    met = interactions.select(F.col("person_id").alias("id")).distinct().withColumn("met", F.lit(True))
    return people.join(matched, "id", "left").join(met, "id", "left").select(
        "id",
        "canonical_name",
        F.coalesce("name_match", F.lit(False)).alias("name_match"),
        (F.col("relation").isNotNull() | F.coalesce("met", F.lit(False))).alias("has_human_signal"),
    )


def edge_degree(edges: DataFrame, type_: str) -> DataFrame:
    """(id, edges): edges touching each row of a type; a self loop counts once."""
    node = lambda side: F.struct(F.col(f"{side}_type").alias("t"), F.col(f"{side}_id").alias("id"))
    # each side by itself, so that edges whose type rules a side out are not read for it
    src = edges.filter(F.col("src_type") == type_).select(F.col("src_id").alias("id"))
    dst = edges.filter((F.col("dst_type") == type_) & ~F.coalesce(node("src") == node("dst"), F.lit(False))).select(F.col("dst_id").alias("id"))
    return src.unionByName(dst).groupBy("id").agg(F.count(F.lit(1)).alias("edges"))


def mistyped(orgs: DataFrame, people: DataFrame, edges: DataFrame, known_orgs: DataFrame) -> DataFrame:
    """Organisations that read like a person's name and people named by a pronoun, with their edge counts."""
    looks = orgs.filter(
        (F.col("created_by") == "system:extract")
        & ~F.col("retired")
        & F.col("canonical_name").rlike(r"^\p{Lu}\p{L}+( \p{Lu}\p{L}+){1,2}$")
        & ~F.lower("canonical_name").rlike(f"({ORG_NAME_CUES})")
    )
    staffed = (
        edges.filter("rel = 'works_at' and src_type = 'person' and dst_type = 'org'")
        .groupBy(F.col("dst_id").alias("id"))
        .agg(F.countDistinct("src_id").alias("staff"))
        .filter("staff >= 2")
    )
    allow = known_orgs.select(F.lower("name").alias("low"))
    flagged = looks.withColumn("low", F.lower("canonical_name")).join(allow, "low", "left_anti").join(staffed, "id", "left_anti")
    pron = people.filter((F.col("created_by") == "system:extract") & F.lower("canonical_name").isin(PRONOUNS))
    degree = lambda found, type_: found.join(edge_degree(edges, type_), "id", "left").withColumn("edges", F.coalesce("edges", F.lit(0).cast("bigint")))
    told = lambda found, kind, type_: found.select(F.lit(kind).alias("kind"), F.lit(type_).alias("type"), "id", F.col("canonical_name").alias("name"))
    # written, so that the edges of a type are counted only if somebody is told
    flagged, pron = (materialize(told(*x), x[1]) for x in ((flagged, "org_should_be_person", "org"), (pron, "person_from_pronoun", "person")))
    return degree(flagged, "org").unionByName(degree(pron, "person"))


def term_list(lines: DataFrame) -> DataFrame:
    """An owner-edited list: one name per line, '#' comments and blanks ignored, case-folded."""
    t = F.trim(F.col("value"))
    return lines.select(t.alias("name")).filter((F.col("name") != "") & ~F.col("name").startswith("#")).select(F.lower("name").alias("name")).distinct()


def retype_orgs(edges: DataFrame, mapping: DataFrame) -> DataFrame:
    """Repoint both ends of every edge from (org_id) to (person_id), drop self loops, keep the oldest of equals.

    Only edges touched by the repair are de-duplicated; the rest pass through unchanged.
    """
    s = mapping.select(F.col("org_id").alias("src_id"), F.lit("org").alias("src_type"), F.col("person_id").alias("_sp"))
    d = mapping.select(F.col("org_id").alias("dst_id"), F.lit("org").alias("dst_type"), F.col("person_id").alias("_dp"))
    moved = (
        edges.join(s, ["src_type", "src_id"], "left")
        .join(d, ["dst_type", "dst_id"], "left")
        .withColumn("src_type", F.when(F.col("_sp").isNotNull(), "person").otherwise(F.col("src_type")))
        .withColumn("src_id", F.coalesce("_sp", "src_id"))
        .withColumn("dst_type", F.when(F.col("_dp").isNotNull(), "person").otherwise(F.col("dst_type")))
        .withColumn("dst_id", F.coalesce("_dp", "dst_id"))
        .drop("_sp", "_dp")
        .filter(~((F.col("src_type") == "person") & (F.col("dst_type") == "person") & (F.col("src_id") == F.col("dst_id"))))
    )
    p = mapping.select("person_id").distinct()
    sp = p.select(F.col("person_id").alias("src_id"), F.lit(True).alias("_ts"))
    dp = p.select(F.col("person_id").alias("dst_id"), F.lit(True).alias("_td"))
    tagged = moved.join(sp, "src_id", "left").join(dp, "dst_id", "left")
    touched = ((F.col("src_type") == "person") & F.coalesce("_ts", F.lit(False))) | (
        (F.col("dst_type") == "person") & F.coalesce("_td", F.lit(False))
    )
    # untouched edges keep their own id in the group key, so they never meet another edge
    solo = F.when(touched, F.lit("")).otherwise(F.col("edge_id"))
    keys = ["src_type", "src_id", "rel", "dst_type", "dst_id", "_solo"]
    rest = [c for c in edges.columns if c not in keys]
    return (
        tagged.withColumn("_solo", solo)
        .groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), F.struct("created_on", "edge_id")).alias("_e"))
        .select("src_type", "src_id", "rel", "dst_type", "dst_id", "_e.*")
    )


class Retyped(NamedTuple):
    """What a repair leaves: every table whole, and one row for each organisation that was asked about."""

    people: DataFrame
    person_aliases: DataFrame
    orgs: DataFrame
    edges: DataFrame
    mapping: DataFrame


def retype(people: DataFrame, person_aliases: DataFrame, orgs: DataFrame, org_aliases: DataFrame, edges: DataFrame, asked: DataFrame, now: Column) -> Retyped:
    """Organisations that are people become people: asked(org_id, relation, reason), a row for each organisation.

    The person of that name (canonical or alias, case folded, smallest id) is reused, else made, one for each name. It
    gets the organisation's name and aliases as aliases, the relation if it has none, and points to the organisation it
    supersedes (the smallest, if it supersedes none yet). Edges move on both ends; those that then join a person with
    itself go, and of equal ones the oldest stays. The organisation is kept, retired with a reason and the first
    stamp. mapping(org_id, person_id, outcome, edges) says reused, created or unknown (no such organisation) and counts
    the person's edges afterwards. Ids are strings from here on. A second run changes nothing.

    One mapping table is joined to each of the others; nothing is gathered, and each result is a table of its own.
    """
    text = lambda c: F.col(c).cast("string").alias(c)
    want = asked.groupBy(F.col("org_id").cast("string").alias("org_id")).agg(F.max("relation").alias("relation"), F.max("reason").alias("reason"))
    o = orgs.select(text("id"), "canonical_name", *[c for c in orgs.columns if c not in ("id", "canonical_name")])
    p = people.select(text("id"), "canonical_name", "relation", F.col("supersedes_id").cast("string").alias("supersedes_id") if "supersedes_id" in people.columns else F.lit(None).cast("string").alias("supersedes_id"))
    a = person_aliases.select(text("id"), "alias")
    known = names(p, a).groupBy(F.lower("name").alias("low")).agg(F.min("id").alias("person_id"))
    m = want.join(o.select(F.col("id").alias("org_id"), "canonical_name"), "org_id", "left").withColumn("low", F.lower("canonical_name")).join(known, "low", "left")
    outcome = F.when(F.col("low").isNull(), "unknown").when(F.col("person_id").isNotNull(), "reused").otherwise("created")
    made = F.when(F.col("low").isNotNull(), F.concat(F.lit("person-"), F.substring(F.sha2("low", 256), 1, 16)))
    m = materialize(m.withColumn("outcome", outcome).withColumn("person_id", F.coalesce("person_id", made)), "retyped")
    found = m.filter("outcome <> 'unknown'")

    given = found.groupBy("person_id").agg(F.min_by("canonical_name", "org_id").alias("_n"), F.max("relation").alias("_r"), F.min("org_id").alias("_o"))
    after = p.join(given, p["id"] == given["person_id"], "full_outer").select(
        F.coalesce("id", "person_id").alias("id"), F.coalesce("canonical_name", "_n").alias("canonical_name"), F.coalesce("relation", "_r").alias("relation"), F.coalesce("supersedes_id", "_o").alias("supersedes_id")
    )
    theirs = org_aliases.select(F.col("id").cast("string").alias("org_id"), "alias").join(found.select("org_id", "person_id"), "org_id")
    aliases = a.unionByName(found.select(F.col("person_id").alias("id"), F.col("canonical_name").alias("alias"))).unionByName(theirs.select(F.col("person_id").alias("id"), "alias")).distinct()

    e = edges.withColumns({"src_id": F.col("src_id").cast("string"), "dst_id": F.col("dst_id").cast("string")})
    moved = materialize(retype_orgs(e, found.select("org_id", "person_id")), "moved")
    counts = edge_degree(moved, "person").withColumnRenamed("id", "person_id")
    mapping = m.join(counts, "person_id", "left").select("org_id", "person_id", "outcome", F.when(F.col("outcome") != "unknown", F.coalesce("edges", F.lit(0).cast("long"))).alias("edges"))

    stamp = [F.col(c) if c in orgs.columns else F.lit(None).cast(t).alias(c) for c, t in (("retired_on", "date"), ("retired_reason", "string"))]
    rest = [c for c in o.columns if c not in ("retired", "retired_on", "retired_reason")]
    gone = found.select(F.col("org_id").alias("id"), F.coalesce("reason", F.lit("retyped to person")).alias("_why"))
    hit = F.col("_why").isNotNull()
    retired = o.select(*rest, "retired", *stamp).join(gone, "id", "left").select(
        *rest, (F.col("retired") | hit).alias("retired"), F.when(hit, F.coalesce("retired_on", now)).otherwise(F.col("retired_on")).alias("retired_on"), F.when(hit, F.coalesce("retired_reason", "_why")).otherwise(F.col("retired_reason")).alias("retired_reason")
    )
    return Retyped(after, aliases, retired, moved, mapping)
