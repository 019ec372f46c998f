import json

from tallyspark.operators import flatten

EVENT = {"event_id": "7", "type": "PullRequestReviewEvent", "payload": {"pull_request": {"number": 3, "labels": [{"id": 1, "name": "bug"}, "perf", None, {"id": 2}]}, "review": {"id": 5}, "comment": {"id": "9"}}}
CHILDREN = {("1", "event", "7"), ("7", "review", "5"), ("7", "comment", "9"), ("7", "label", "bug"), ("7", "label", "perf")}
PRS = "id long, bq_events string, pr_id string"


def links(frame, text):
    return {(r.parent_id, r.child_kind, r.child_id) for r in flatten.event_links(frame([(1, text, "clash")], PRS)).collect()}


def test_every_accepted_shape_gives_the_same_links(frame):
    as_text = EVENT | {"payload": json.dumps(EVENT["payload"])}
    nodes = json.loads(json.dumps(EVENT))
    nodes["payload"]["pull_request"]["labels"] = {"nodes": [{"name": "bug"}, {"name": "perf"}]}
    for text in (
        json.dumps([EVENT]), json.dumps(EVENT), json.dumps({"events": [EVENT], "page": {"next": None}}), json.dumps(json.dumps([EVENT])), json.dumps([as_text]),
        json.dumps(EVENT) + "\n" + json.dumps(EVENT) + "\n", json.dumps(EVENT | {"event_id": 7}), json.dumps([nodes, None, 3]), "  " + json.dumps([EVENT], indent=2) + "\n",
    ):
        assert links(frame, text) == CHILDREN, text


def test_incomplete_or_invalid_text_yields_nothing(frame):
    whole = json.dumps([EVENT])
    for text in (None, "", " ", "null", "[]", "{}", "5", whole[:-1], whole[: len(whole) // 2], whole + "]", whole + " x", json.dumps(EVENT) + ",", json.dumps(EVENT) + "," + json.dumps(EVENT), json.dumps(EVENT) + "\n" + json.dumps(EVENT)[:-3], "[1],[2", '{"event_id": }'):
        assert links(frame, text) == set(), text


def test_missing_parts(frame):
    assert links(frame, json.dumps([{"event_id": None}, {"payload": EVENT["payload"]}, {"event_id": "8", "payload": None}, {"event_id": "9", "payload": {"comment": None, "review": {}, "pull_request": {"labels": None}}}])) == {("1", "event", "8"), ("1", "event", "9")}


def test_tables_keep_order_and_positions(frame):
    prs = frame([(1, json.dumps([EVENT, EVENT | {"event_id": "8", "payload": {}}]), "x")] * 2, PRS)
    assert sorted((r.event_ix, r.event_id, r.pr_number) for r in flatten.event_table(prs).collect()) == [(0, "7", 3), (1, "8", None)]
    assert sorted((r.label_ix, r.label) for r in flatten.label_table(prs).collect()) == [(0, "bug"), (1, "perf")]


def test_files_in_all_forms(frame):
    f = {"filename": "a.py", "status": "added"}
    forms = {"[f]": [f, f], "f": f, "map": {"a.py": {"status": "added"}}, "text": json.dumps([f])}
    for name, value in forms.items():
        t = frame([(1, 2, json.dumps({"files_detail": value}))], "pr_id long, event_id long, data string")
        assert {(r.parent_id, r.child_id) for r in flatten.file_links(t).collect()} == {("2", "a.py")}, name
        assert [(r.event_id, r.file_name) for r in flatten.file_table(t).collect()] == [(2, "a.py")]
    for text in (r'{"files\u005fdetail": [{"filename": "a.py"}]}', r'"{\"files\\u005fdetail\": [{\"filename\": \"a.py\"}]}"', r'"{\"\u0066iles_detail\": {\"filename\": \"a.py\"}}"'):
        t = frame([(1, 2, text)], "pr_id long, event_id long, data string")
        assert [r.child_id for r in flatten.file_links(t).collect()] == ["a.py"], text
    for value in ({}, [], None, 5, [{}]):
        t = frame([(1, 2, json.dumps({"files_detail": value})), (1, 3, None), (1, 4, '{"files_detail":[')], "pr_id long, event_id long, data string")
        assert flatten.file_links(t).collect() == []


THREADS = "thread_id string, pr_id long, comments array<struct<id:bigint,body:string,path:string,line:int,original_line:int,diff_hunk:string,author:string,created_at:string,reactions:map<string,int>>>"


def test_threads(frame):
    c = lambda i, r: (i, None, None, None, None, None, None, None, r)
    t = frame([("T", 1, [c(4, {"+1": 2, "EYES": 0, "X": None}), c(4, {"+1": 2}), c(None, {"+1": 1}), c(5, None)]), ("U", 1, []), ("V", 1, None)], THREADS)
    assert {(r.parent_id, r.child_kind, r.child_id) for r in flatten.thread_links(t).collect()} == {("T", "thread_comment", "4"), ("T", "thread_comment", "5"), ("4", "reaction", "+1")}
    assert [(r.thread_id, r.comment_id, r.reaction, r.n) for r in flatten.reaction_table(t).collect()] == [("T", 4, "+1", 2)]


def test_child_links_are_distinct(frame):
    prs = frame([(1, json.dumps([EVENT]), "x")] * 5, PRS)
    t = frame([], "pr_id long, event_id long, data string")
    assert len(flatten.child_links(prs, t, frame([], THREADS)).collect()) == len(CHILDREN)


def test_payload_and_comment_tables(frame):
    review = EVENT | {"payload": {"review": {"id": 5, "state": "approved", "body": None, "commit_id": "c1"}, "comment": {"id": 9, "body": "b", "path": "p", "line": "x"}}}
    prs = frame([(1, json.dumps([review, review]), "x"), (2, json.dumps([EVENT | {"event_id": None}]), "x"), (3, None, None)], PRS)
    assert [tuple(r) for r in flatten.review_table(prs).collect()] == [(1, 0, "7", "5", "approved", None, "c1")]
    assert [tuple(r) for r in flatten.comment_table(prs).collect()] == [(1, 0, "7", "9", "b", "p", None)]
    c = (4, "b", "p", 1, 2, "h", "a", "t", {"+1": 2, "EYES": 0})
    t = frame([("T", 1, [c, c]), ("U", 1, []), (None, 1, [c]), ("V", 1, None)], THREADS)
    assert [tuple(r) for r in flatten.thread_comment_table(t).collect()] == [(1, "T", 0, 4, "b", "p", 1, 2, "h", "a", "t", 1)]


def test_files_keep_their_fields(frame):
    t = frame([(1, 2, json.dumps({"files_detail": [{"filename": "a", "status": "added", "additions": 3, "deletions": "x"}, "b", {"filename": "a"}]}))], "pr_id long, event_id long, data string")
    assert sorted(tuple(r) for r in flatten.file_table(t).collect()) == [(1, 2, 0, "a", "added", 3, None), (1, 2, 1, "b", None, None, None)]
