import json

from pyspark.sql import functions as F

from corpusmill.operators import nested, threads


def post(i, text="t", re=None, **more):
    return {"legacy": {"id_str": str(i), "full_text": text, **({"in_reply_to_status_id_str": re} if re is not None else {}), **more}}


def table(spark, *payloads):
    return spark.createDataFrame(list(payloads), "payload_id long, payload string").withColumn("type", F.lit("clash"))


def test_labels_nest():
    value = {"a": [{"b": 1}, {"b": {"b": 2}}], "c": {}}
    nodes = nested.label(value, lambda p, n: ("any", {}))
    spans = {n[1]: n[2] for n in nodes}
    assert len(nodes) == len(spans) == 8 and nodes[0][:4] == ("any", 0, 7, 0)
    inside = {(a, b) for a in spans for b in spans if a < b and spans[b] < spans[a]}
    # an interval lies wholly inside or wholly outside another: whatever lies inside b lies inside what holds b
    assert all((a, c) in inside for a, b in inside for b2, c in inside if b == b2)
    assert [sum((a, b) in inside for a in spans) for b in sorted(spans)] == [n[3] for n in sorted(nodes, key=lambda n: n[1])]


def test_deep_nesting():
    value = []
    for _ in range(50_000):
        value = [value]
    assert len(nested.label(value, lambda p, n: None)) == 0


def test_deep_records_keep_all_nodes(spark):
    deep = '{"a": ' * 100_000 + json.dumps(post(2, re="1")) + "}" * 100_000
    lists = "[" * 100_000 + json.dumps(post(2, re="1")) + "," + json.dumps(post(1)) + "]" * 100_000
    df = table(spark, (1, '{"x": ' + json.dumps(post(1)) + ', "y": ' + deep + "}"), (2, lists), (3, "[" * 100_000))
    assert sorted(map(tuple, nested.reply_links(df).collect())) == [(1, "1", "2"), (2, "1", "2")]
    assert {r.payload_id: (r.valid, r.n_posts) for r in nested.payload_table(df).collect()} == {1: (True, 2), 2: (True, 2), 3: (False, 0)}


def test_reader_with_a_stack_agrees_with_the_recursive_one():
    good = ['{"a": [1, -2.5e3, true, null, "\\u00e9\\n"], "b": {}, "a": []}', " [] ", '"x"', "0", "-0.0", "[[],[{}]]", '{"a":{"b":[false]}}', "1e400"]
    bad = ["", "[1,]", "{,}", '{"a"}', '{"a":}', "[1 2]", "01", "[NaN]", "Infinity", "tru", '"\t"', "[1]]", '{"a":1,}', "{1:2}", "nul", "-", "[", '{"a":1']
    for text in good + bad:
        try:
            want = json.loads(text, parse_constant=nested._no_constant)
        except ValueError:
            want = ValueError
        try:
            got = nested._read(text)
        except ValueError:
            got = ValueError
        assert got == want, text
    assert nested.parse_strict("[" + "9" * 5_000 + "]") == (True, ["9" * 5_000])


def test_replies_and_dirty_payloads(spark):
    good = json.dumps({"x": [post(1), {"deep": {"items": [post(2, re="1"), post(3, re=2), post(3, re="2")]}}, post(4, re="9"), post(5, re=None)]})
    df = table(spark, (1, good), (1, good), (2, None), (3, ""), (4, good[:40]), (5, '{"legacy": {"full_text": null}}'), (6, "[NaN]"), (7, "{}"))
    assert sorted(map(tuple, nested.reply_links(df).collect())) == [(1, "1", "2"), (1, "2", "3")]
    valid = {r.payload_id: (r.valid, r.n_posts) for r in nested.payload_table(df).collect()}
    assert valid == {1: (True, 6), 2: (False, 0), 3: (False, 0), 4: (False, 0), 5: (True, 0), 6: (False, 0), 7: (True, 0)}


def test_tables_keep_parents(spark):
    inner = post(2, entities={"media": [{"media_url_https": "https://p/x?name=small"}], "hashtags": [{"text": "h"}]}, favorite_count="7")
    outer = post(1, favorite_count=3, quoted=inner, entities={"hashtags": [{"text": "o"}]})
    df = table(spark, (1, json.dumps(outer)))
    posts = {r.id_str: r for r in nested.post_table(df).collect()}
    assert posts["2"].parent_post_key == posts["1"].post_key and posts["1"].parent_post_key is None
    assert (posts["1"].favorite_count, posts["2"].favorite_count) == (3, 7)
    got = {(r.kind, r.value): r.post_key for r in nested.attachment_table(df).collect()}
    assert got == {("hashtags", "o"): posts["1"].post_key, ("hashtags", "h"): posts["2"].post_key, ("media", "https://p/x?name=small"): posts["2"].post_key}
    assert "Media Attached:\n*(https://p/x?name=orig)\n" in threads.rendered(df).first().body


def test_empty_table(spark):
    empty = spark.createDataFrame([], "payload_id long, payload string")
    assert nested.reply_links(empty).count() == nested.post_table(empty).count() == nested.attachment_table(empty).count() == 0


def saved(i, text, handle=None, **more):
    author = {"core": {"user_results": {"result": {"legacy": {"screen_name": handle, "name": handle.title()}}}}} if handle else {}
    return {"result": {**author, "legacy": {"id_str": str(i), "full_text": text, "created_at": "May 1", **more}}}


def test_threads_are_rendered_with_authors(spark):
    reply = {"in_reply_to_status_id_str": "7", "in_reply_to_screen_name": "ann"}
    payload = {"entries": [saved(5, "first", "bob", favorite_count=2, **reply), saved(7, "two\nlines", "ann", retweet_count="x", reply_count=3), saved(8, "own", "ann", **reply), {"tombstone": 1}]}
    df = spark.createDataFrame([(1, "https://x.com/ann/status/7", json.dumps(payload))] * 2 + [(2, None, "{"), (3, "u", "[]")], "payload_id long, url string, payload string")
    body = {r.payload_id: r.body for r in threads.rendered(df).collect()}
    assert body == {
        1: "Twitter Thread by @ann\nThread URL: https://x.com/ann/status/7\n\n1. @ann (Ann)\nPosted at: May 1 | Likes: 0 | Retweets: 0 | Replies: 3\n> two\n> lines\n---\n\n"
        "2. @bob (Bob)\nPosted at: May 1 | Likes: 2 | Retweets: 0 | Replies: 0\nReplying to @ann\n> first\n---\n\n3. @ann (Ann)\nPosted at: May 1 | Likes: 0 | Retweets: 0 | Replies: 0\nReplying to @ann\n> own\n---\n\n"
    }
    xml = threads.rendered(df, "anthropic").first().body
    assert xml.startswith('<twitter_thread source_url="https://x.com/ann/status/7">\n  <focal_tweet id="7">\n    <metadata>\n      <author username="@ann" display_name="Ann" />')
    assert '    <tweet id="5" relationship="external_reply" parent_id="7">' in xml and '<tweet id="8" relationship="self_reply"' in xml and "<text>two\n      lines</text>" in xml and xml.endswith("</twitter_thread>\n")


def test_second_shape_of_threads():
    value = {
        "focal": {"data": {"id": "1", "text": "t", "author_id": "u2", "created_at": "now", "public_metrics": {"like_count": 4}}, "includes": {"users": [{"id": "u1", "username": "no"}, {"id": "u2", "username": "yes", "name": "Yes"}, {"id": "u2", "username": "late"}]}},
        "thread": {"data": [{"id": "3", "text": "newest", "author_id": "u9"}, {"id": "2", "text": "older", "author_id": "u1"}]},
    }
    focal, others = threads.thread(value, "")
    assert (focal["handle"], focal["name"], focal["likes"]) == ("yes", "Yes", 4) and [(p["id"], p["handle"]) for p in others] == [("2", "no"), ("3", "unknown")]
    assert threads.as_markdown(focal, others, "u").count("---") == 3 and threads.thread({"focal": {"data": "x"}}, "") == (None, [])


def test_shared_conversations(spark):
    turns = [[[[["Hi?"]], [["Hello."]]]], ["x", ["note"]], ["x", 1, "flat"], [None], 5]
    chunk = lambda data: json.dumps([["wrb.fr", "id", json.dumps(data)]])
    raw = ")]}'\n\n12\n" + chunk([turns]) + "\n25\n{\"a\": 1}\n7\n[broken\n9\n" + chunk([None, 1, "Title"]) + "\n3"
    want = "# Gemini Conversation: Title\nSource URL: u\n\n# Gemini Conversation Share\nSource URL: u\n\n**User:**\nHi?\n\n**Gemini:**\nHello.\n\n**Message:**\nnote\n\n**User:**\nflat\n\n"
    df = spark.createDataFrame([(1, "u", raw), (2, None, ""), (3, "u", None)], "ord long, url string, body string")
    got = {r.ord: r.text for r in threads.conversations_parsed(df).collect()}
    assert got == {1: want, 2: "# Gemini Conversation Share\nSource URL: \n\nFailed to parse conversation chunks, or empty answer."}
