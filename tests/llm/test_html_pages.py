"""Main text of pages: texts that were once lost, and random pages whose article is known as they are made."""

import random

import pytest

from orbitlake.llm import html

SAID = "This is the text of the article, and it has the words that all of the texts have, so that it is found by them."
LANGUAGES = {
    "ru": "Это текст статьи, и в нём есть слова, которые есть во всех текстах на этом языке, и он достаточно длинный, чтобы его можно было найти на странице по длине и по тому, что в нём нет ссылок, и не только по словам, которые в нём есть, а их немало.",
    "zh": "这是一篇文章的正文，它包含了这种语言的所有文本中都有的字词，并且足够长，可以通过它的长度和链接密度被找到，而不是通过停用词列表。这篇文章没有任何链接，因此应该被保留下来，不应该丢失。",
    "it": "Questo è il testo dell'articolo, che contiene le parole che si trovano in tutti i testi di questa lingua, ed è abbastanza lungo per essere trovato anche senza le parole, perché non ha collegamenti e perché è lungo come gli altri testi della pagina.",
    "fi": "Tämä on kirjoituksen teksti, ja siinä on sanat, jotka ovat kaikissa tämän kielen teksteissä, ja se on niin pitkä, että se löytyy sivulta pituutensa ja linkkien puuttumisen perusteella eikä vain sanojensa takia, joita luettelossa ei ole lainkaan.",
}


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (f"<article><h1><a href=x>Headline of the article</a></h1><p>{SAID}</p></article>", f"Headline of the article {SAID}"),
        (f"<article><p>{SAID}</p><p>See <a href=x>this</a> too.</p></article>", f"{SAID} See this too."),
        (f"<article><p>{SAID}</p><ul><li>One <a>x</a></li><li>Two words</li></ul></article>", f"{SAID} One x Two words"),
        (f"<article><p>{SAID}</p><ul><li><a>Menu</a></li><li><a>More</a></li></ul></article>", SAID),
        (f"<p><a href=x>{'&nbsp;' * 60}</a>{SAID} {SAID}</p>", f"{SAID} {SAID}"),
        (f"<p><a href=x>{'&amp;' * 30}</a> {SAID} {SAID}</p>", f"{'&' * 30} {SAID} {SAID}"),
        (f"<div class='content sidebar'><p>{SAID} {SAID}</p></div>", f"{SAID} {SAID}"),
        (f"<div class='post share'><p>{SAID} {SAID}</p></div>", f"{SAID} {SAID}"),
        (f"<div class='widget text'><p>{SAID} {SAID}</p></div>", f"{SAID} {SAID}"),
        (f"<div class=sidebar><p>{SAID} {SAID}</p></div>", f"{SAID} {SAID}"),
        (f"<div class=sidebar><p>{SAID} No.</p></div><div><p>{SAID} {SAID}</p></div>", f"{SAID} {SAID}"),
        (f"<div class='comment text'><p>{SAID} {SAID}</p></div>", ""),
        (f"<div class='ad content'><p>{SAID} No.</p></div><p>{SAID} {SAID}</p>", f"{SAID} {SAID}"),
        (f"<div><p>{SAID} {SAID} {SAID}</p><p>{SAID} {SAID}</p></div><article><h2><a>More</a></h2><p>A teaser.</p></article>", f"{SAID} {SAID} {SAID} {SAID} {SAID}"),
        # between text and links, the nearer decides; of two as near, a heading goes with what follows
        (f"<p>{SAID} {SAID}</p><p>Short.</p><p>Short too.</p><p><a>x y z</a></p>", f"{SAID} {SAID} Short."),
        (f"<p><a>x y z</a></p><h2>Heading</h2><p>{SAID} {SAID}</p><h2>Last</h2><p><a>x y z</a></p>", f"Heading {SAID} {SAID}"),
    ],
)
def test_nothing_of_the_article_is_lost(page, text):
    assert html.main_text(page) == html.main_text(f"<html><body>{page}</body></html>") == text


@pytest.mark.parametrize("language", LANGUAGES)
def test_languages_without_a_list(language):
    text = LANGUAGES[language]
    menu = "<ul><li><a href=a>Menu</a></li><li><a href=b>Link</a></li></ul>"
    assert html.main_text(f"<body>{menu}<p>{text}</p><p>{text} {text}</p>{menu}</body>") == f"{text} {text} {text}"


def made(r):
    """A page and its article's text: what is left out is marked by its element or words, nested at random."""
    said = lambda: " ".join(r.choice(SAID.split()) for _ in range(r.choice([3, 9, 30, 80])))
    kept = []

    def noise():
        text = said()
        return r.choice([
            f"<nav><ul><li><a href='{text[:3]}'>{text}</a></ul></nav>", f"<aside><p>{text}</p></aside>", f"<div class='{r.choice(['ad', 'x cookie-bar cookie', 'Sponsored post'])}'><p>{text}</div>",
            f"<form><label>{text}<input></label></form>", f"<script>var a = '<p>{text}</p>';</script>", f"<!-- <p>{text}</p> -->", f"<p hidden>{text}</p>",
            f"<section id=comments><div class=comment><p>{text}</p></div></section>", f"<style>p {{ {text} }}</style>", f"<footer>{text}</footer>",
        ])

    def block(depth):
        if depth and r.random() < 0.3:
            return f"<{(tag := r.choice(['div', 'section', 'blockquote', 'ul']))}>" + "".join(block(depth - 1) for _ in range(r.randrange(1, 4))) + f"</{tag}>"
        if r.random() < 0.25:
            return noise()
        text = said()
        words = text.split()
        kept.append(f"{text} & é")
        k = r.randrange(len(words))
        link = f"<a href=x>{words[k]}</a>" if len(words) > 2 and r.random() < 0.5 else f"<em>{words[k]}</em>"
        inner = "\n ".join([*words[:k], link, *words[k + 1 :]]) + " &amp; &eacute;"
        return r.choice(["<p>{}</p>", "<h2>{}</h2>", "<div>{}</div>", "<table><tr><td>{}</td></tr></table>"]).format(inner)

    body = "".join(block(3) for _ in range(r.randrange(1, 12)))
    outer = r.choice(["<article>{}</article>", "<main><div>{}</div></main>", "<div class=sidebar><article class=post>{}</article></div>"]).format(body)
    return f"<html><head><title>no</title></head><body>{noise()}{noise()}{outer}{noise()}</body></html>", " ".join(kept)


def test_random_pages_give_the_article_they_were_made_of():
    for seed in range(400):
        page, text = made(random.Random(seed))
        assert html.main_text(page) == text, seed
