"""Pages written by hand, in layouts that the training generator does not know, labelled block by block."""

from tetrad.llm import html

HARBOUR = """<!DOCTYPE html><html lang="en"><head><title>Harbour ferries return</title><style>.x{color:red}</style></head><body>
<header><a href="/">The Daily Tide</a><nav><ul><li><a href="/news">News</a></li><li><a href="/sport">Sport</a></li><li><a href="/weather">Weather</a></li></ul></nav></header>
<main><article><h1>Harbour ferries return after a decade</h1><p class="byline">By Ann Other</p>
<p>The last wooden ferry left the harbour ten years ago, and few people in the town believed that another would ever follow it across the bay.</p>
<p>This morning two small boats, painted in the old colours of green &amp; white, tied up at the north pier while a crowd of several hundred watched from the wall.</p>
<blockquote><p>&ldquo;We had to learn everything again,&rdquo; said the captain, who had spent the winter repairing both engines by hand.</p></blockquote>
<p>Tickets are sold on board. The crossing takes about twenty minutes when the wind is kind, and rather longer when it is not.</p></article>
<aside><h3>Most read</h3><ul><li><a href="/1">Ten best beaches</a></li><li><a href="/2">Where to park</a></li></ul></aside></main>
<section id="comments"><h2>Comments (2)</h2><div class="comment"><p>Great news! Can't wait to ride it.</p></div><div class="comment"><p>About time.</p></div></section>
<footer><p>&copy; 2024 The Daily Tide. All rights reserved.</p><a href="/privacy">Privacy</a> <a href="/terms">Terms</a></footer><script>var a = "<p>not text</p>";</script></body></html>"""
BREAD = """<html><body><div id="wrap"><div class="top-menu"><a href="#">Home</a> | <a href="#">Recipes</a> | <a href="#">Contact</a></div>
<div class="cookie-banner">We use cookies to improve your experience. <button>Accept</button></div>
<div class="content"><div class="post"><h2>Plain bread without kneading</h2>
<div>Mix the flour with salt and a very small amount of yeast, then pour in the water and stir with a spoon until no dry flour is left in the bowl.</div>
<div>Cover it and leave it alone for eighteen hours. Nothing more needs to be done in that time, whatever older books may tell you about folding.</div>
<ul><li>500 g of flour, sifted once</li><li>10 g of salt</li><li>350 ml of water</li></ul>
<div>Bake it in a closed pot for half an hour, then open the lid and wait until the crust is as dark as you like it.</div></div>
<div class="sidebar"><b>Categories</b><br><a href="#">Bread</a><br><a href="#">Soup</a><br></div>
<div class="ad">Advertisement: Buy the new SuperMixer 3000 today and save 20%!</div>
<form action="/subscribe"><label>Your e-mail</label><input name="m"><button>Subscribe to our newsletter</button></form></div>
<div class="bottom">Copyright 2019 | Powered by TinyBlog | <a href="#">Imprint</a></div></div></body></html>"""

HARBOUR_TEXT = [
    "Harbour ferries return after a decade",
    "By Ann Other",
    "The last wooden ferry left the harbour ten years ago, and few people in the town believed that another would ever follow it across the bay.",
    "This morning two small boats, painted in the old colours of green & white, tied up at the north pier while a crowd of several hundred watched from the wall.",
    "“We had to learn everything again,” said the captain, who had spent the winter repairing both engines by hand.",
    "Tickets are sold on board. The crossing takes about twenty minutes when the wind is kind, and rather longer when it is not.",
]
BREAD_TEXT = [
    "Plain bread without kneading",
    "Mix the flour with salt and a very small amount of yeast, then pour in the water and stir with a spoon until no dry flour is left in the bowl.",
    "Cover it and leave it alone for eighteen hours. Nothing more needs to be done in that time, whatever older books may tell you about folding.",
    "500 g of flour, sifted once",
    "10 g of salt",
    "350 ml of water",
    "Bake it in a closed pot for half an hour, then open the lid and wait until the crust is as dark as you like it.",
]


def test_pages_of_other_layouts(spark):
    rows = [(1, "a", HARBOUR), (2, "b", BREAD), (3, "c", HARBOUR.replace("\n", " ").replace("<article>", "<div class='story'>").replace("</article>", "</div>"))]
    got = {r["page_id"]: r["text"] for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[1].split("\n\n") == HARBOUR_TEXT == got[3].split("\n\n")
    assert got[2].split("\n\n") == BREAD_TEXT
