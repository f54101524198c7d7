from notewell.llm import html_extract


def test_all_parts_of_an_article_without_a_winning_path():
    """The first part is so long that it outweighs what holds both."""
    line = "<p>{0} sentence, with commas, and enough words to count as prose for the score of this box, surely.</p>"
    part = lambda name, n: f"<div class=story>{line.format(name) * n}</div>"
    page = "<html><body>" + part("Early", 30) + "<div class=ad>Buy now</div>" + part("Late", 2) + "</body></html>"
    boxes = html_extract.parse(page)[1]
    assert html_extract.best(boxes).path == "body/div.story"
    text = html_extract.extract(page, [])
    assert text == html_extract.extract(page, ["body/div.story"]) and "Early" in text and "Late" in text and "Buy" not in text
