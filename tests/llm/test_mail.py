from folioscope.llm import mail

SENDER = "Ann Example <ann.example@x.example>"


def kept(text, author=SENDER):
    lines = text.split("\n")
    return [lines[k] for k in mail.mail_lines(text, author)]


HEAD = f"From: {SENDER}\nSent: 1/2/2015\nTo: Bob\nSubject: trip\n\n"


def test_quotes_and_signature():
    text = HEAD + "Hi Bob,\nI agree with all of it.\n\nBest,\nAnn Example\n-- \nAnn Example\nRegistrar\nTel. 555-0100\n\nSent from my handset\n\nOn Jan 1, 2015 at 3:00 PM,\nBob Doe <bob@y.example> wrote:\n> Old words.\n> \n> Cheers,\n> Bob"
    assert kept(text) == ["Hi Bob,", "I agree with all of it."]


def test_answers_between_quotes():
    text = HEAD + "Bob Doe <bob@y.example> wrote on 1/1/2015:\n> First question?\n\nYes to that.\n\n> Second one\n\nNo to this.\n\nAnn Example\nRegistrar"
    assert kept(text) == ["Yes to that.", "No to this."]


def test_decoys_and_forward():
    text = HEAD + "From: my point of view it can be dropped.\nOn Monday I wrote: nothing happens.\n\n-----Original Message-----\nFrom: Bob <b@y.example>\nDate: 1/1/2015\n\nOld words\n\nThis message may contain privileged information."
    assert kept(text) == ["From: my point of view it can be dropped.", "On Monday I wrote: nothing happens."]


def test_indented_quote_and_furniture():
    text = HEAD + "New words here\nPage 1 of 2\nTRIP\nand more of them.\n\nOn 1/1/2015, Bob <b@y.example> wrote:\n    Old words\n    more"
    assert kept(text) == ["New words here", "and more of them."]


def test_previews():
    assert mail.preview_lines("> Hi Ann,\n\nmy answer in between\n\n> His words go on", "Bob") == [0, 4]
    assert mail.preview_lines("First line\n    second line\n    third\nthe sender's own", "Bob") == [0, 1, 2]
    assert mail.preview_lines("> > Text of his.\n> > -- \n> > Bob\n> later", "Bob") == [0]
    assert mail.preview_lines("", "Bob") == []


def test_subtract_merges_intervals():
    lines = ["one two three", "four five six seven", "new"]
    assert mail.Patterns(["one two three four", "four five six seven"]).subtract(lines, [0, 1, 2]) == [2]
    assert mail.Patterns().subtract(lines, [0, 1, 2]) == [0, 1, 2]
    # A pattern matches whole words, over line ends and broken words.
    assert mail.Patterns(["the attorneyclient privilege holds"]).subtract(["the attorney-", "client privilege", "holds", "holdsx the"], [0, 1, 2, 3]) == [3]
    notice = mail.Patterns((), ["this note is meant for nobody but you and yours"])
    assert notice.subtract(["This note is meant for nobody 6ut", "you and yours", "This note is new to everybody here"], [0, 1, 2]) == [2]
    assert notice.begins("this note is me") and not notice.begins("this note was")


def test_long_headers_and_signatures(spark):
    """A header of any length hides nothing behind it, and texts of nothing but such lines take linear time."""
    import time

    text = HEAD + "Mine.\n\n" + "From: Bob\nTo: Ann\n" + "Cc: Eve\n" * 60 + "\nOld words\n"
    assert kept(text) == ["Mine."]
    long_signature = HEAD + "Mine.\n\nAnn Example\n" + "".join(f"Branch Office {c}\n" for c in "ABCDEFGHIJKL")
    assert kept(long_signature) == ["Mine."]
    began = time.time()
    for line in ("Subject: x\n", "Ann Example\n", "Ann Example,\n", "On 1 May\n", "> > x\n", "--\n"):
        kept(HEAD + line * 20_000)
    assert time.time() - began < 30


def test_the_automata_are_needed(spark, monkeypatch):
    """Without the automata lines of notices and devices are taken for new, and nothing is won."""
    from folioscope.tables import table

    folder = "/root/testdata/sf0.01"
    args = [table(spark, folder, n) for n in ("documents", "email_metadata", "thread_messages")]
    full = {tuple(r) for r in mail.found(*args).collect()}
    monkeypatch.setattr(mail, "common_closings", lambda counted: ([], frozenset()))
    none = {tuple(r) for r in mail.found(*args).collect()}
    assert len(none - full) >= 0.02 * len(full) and len(full - none) <= 0.001 * len(full)


def test_earlier_mail_of_the_thread(spark):
    """Sentences of the mail that is answered are known though the answer repeats them without marks."""
    old = "The ledger of the harbor company went to the second office."
    d = spark.createDataFrame([(1, HEAD + old), (2, HEAD + f"As you say below.\n\n{old}\n\nMy own words are these.")], "doc_id long, full_text string")
    m = spark.createDataFrame([(1, SENDER, "<a@x>", None), (2, SENDER, "<b@x>", "<a@x>")], "doc_id long, from_addr string, message_id string, in_reply_to string")
    t = spark.createDataFrame([], "doc_id long, message_index int, author string, content_preview string")
    assert {r.doc_id: r.new_text for r in mail.new_text(d, m, t).collect()} == {1: old, 2: "As you say below.\nMy own words are these."}


def test_tables(spark):
    d = spark.createDataFrame([(1, HEAD + "Hello\n> x", "s"), (2, None, "s"), (3, "", "s"), (4, HEAD + "no mail", "s")], "doc_id long, full_text string, sender string")
    m = spark.createDataFrame([(1, SENDER, None, None), (1, SENDER, None, None), (2, None, None, None), (3, None, None, None)], "doc_id long, from_addr string, message_id string, in_reply_to string")
    t = spark.createDataFrame([(1, 0, None, "Old words\n\nBest,"), (1, 0, None, "Old words\n\nBest,"), (1, 1, "x", None)], "doc_id long, message_index int, author string, content_preview string")
    got = {tuple(r) for r in mail.found(d, m, t).collect()}
    assert got == {("full_text", 1, -1, 6), ("content_preview", 1, 0, 1)}
    assert {r.doc_id: r.new_text for r in mail.new_text(d, m, t).collect()} == {1: "Hello", 3: ""}
    assert mail.found(d.limit(0), m, t.limit(0)).count() == 0
