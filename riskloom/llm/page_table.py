"""The labelled table of blocks: small made-up pages. A block's text starts with + where it is main text, with - elsewhere."""

PAGES = (
    """<body><nav><ul><li><a href=/>- Home</a><li><a href=/a>- About us</a><li><a href=/n>- News</a></ul></nav>
    <div class="ad">- Buy the best shoes here today.</div><article><h1>+ Rain over the northern hills</h1>
    <p>+ Rain fell for three days over the hills, and the river rose by a metre before it turned on Sunday night.</p>
    <p>+ So it was.</p><p>+ The farmers had seen it coming and moved their cattle to the upper fields in good time.</p>
    </article><footer>- © 2020 The Hill Post · All rights reserved by us.</footer>""",
    """<body><header><a href=/>- The Daily Paper</a><p>- News from all over the county</p></header>
    <main><h2>+ A bridge is closed</h2><p>+ The old bridge was closed on Monday after a crack was found in one of its piers, the council said.</p>
    <p>+ See the <a href=x>full report</a> for the reasons and the dates of the works.</p>
    <ul><li>+ The east side opens in May.</li><li>+ The west side in June.</li></ul>
    <aside><h3>- Most read</h3><a href=1>- Ten ways to cook an egg</a></aside></main>
    <div id="comments"><h3>- 2 comments</h3><p>- I have lived here for forty years and never have I seen the bridge in such a state, it is a shame.</p>
    <p>- Same here.</p></div><form><label>- Your comment</label></form><footer><a href=t>- Terms</a></footer>""",
    """<body><div class="cookie-notice">- We use cookies to make this site work and to measure how it is used by our visitors.</div>
    <div class="sidebar"><p>- Our newsletter brings you the best stories of the week every Friday morning, free of charge.</p></div>
    <div><p>+ When the harvest was in, the people of the village met at the mill, as they did each year, and danced until the morning.</p>
    <p>+ The miller played, his brother sang, and nobody thought of the winter that stood before the door already.</p>
    <p>+ It was late when the last of them went home along the river, and the moon had long gone down behind the wood.</p></div>
    <div class="share"><a href=f>- Share this</a></div><div class="related"><a href=r>- More about harvests</a></div>""",
    """<body><ul><li><a href=1>- Start</a></li><li><a href=2>- Sport</a></li><li><a href=3>- Contact</a></li></ul>
    <table><tr><td><p>+ Our team won the cup after a long and even match in which both keepers did more than could be asked of them.</p>
    <p>+ The goal fell in the last minute of extra time, when hardly anybody in the stands still believed in it at all.</p></td></tr></table>
    <p><a href=p>- Previous</a> <a href=n>- Next</a></p><p>- Copyright 2019</p>""",
    """<body><article><div class="advert">- Advertisement: the new car is here, and it is fast.</div><h1>+ Notes on tides</h1>
    <p>+ High.</p><p>+ Low.</p><p>+ Between the two lie about six hours, a little more on some coasts, and far less in a few odd bays.</p>
    <div class="newsletter"><p>- Sign up and get the tides of your coast by mail each morning before you have had your tea.</p></div>
    <blockquote>+ The sea waits for nobody, my father said.</blockquote></article><nav><a href=b>- Back to the list</a></nav>""",
    """<body><main><article><h1>+ Bread</h1><p>+ Flour, water, salt.</p><p>+ Mix them, wait a day, and bake what you have for about an hour.</p></article></main>
    <aside>- A word from our friends at the flour mill, who made this recipe possible with their kind support.</aside>
    <footer><p>- Impressum</p><p>- Printed in the old town since 1894 by the same family and still not tired of it.</p></footer>""",
    """<body><div class="menu"><a href=1>- One</a> <a href=2>- Two</a></div><div class="content"><h1>+ The long way home from the market</h1>
    <p>+ There are three ways home from the market, and the longest of them is the one that I have always liked best of all.</p>
    <p>+ It leads past the <a href=k>kiln</a>, over the weir and through the orchard, and takes an hour if you do not stop for plums.</p></div>
    <div class="popup">- Before you go: tell your friends about us and win a basket of plums.</div><div>- 12 May 2021</div>""",
    """<body><header class="top"><nav><a href=1>- Index</a></nav><form>- Search the site</form></header>
    <article><header><h1>+ On clocks</h1></header><section><p>+ A clock that stands is right twice a day.</p><p>+ True.</p></section>
    <section class="comments"><p>- Mine runs backwards and so is right four times a day, or so my uncle has worked out on paper.</p></section></article>""",
    """<body><nav>- Menu</nav><article><p>+ One.</p><p>+ Two words.</p><p>+ Three short words.</p><p><a href=x>+ A line that is a link</a></p></article>
    <div class="footer"><a href=1>- Imprint</a> <a href=2>- Privacy</a></div>""",
    """<body><article><p>+ Hello there</p></article>""",
    """<body><nav><a href=1>- Start</a></nav><article><p>+ Be.</p></article><footer>- © us</footer>""",
    """<body><article><h1>+ On salt</h1></article>""",
    """<body><article><p>+ A lone paragraph of a page that has nothing else to say and nobody to say it to, either.</p></article>""",
    """<body><main><p>+ Yes.</p><p>+ No.</p></main>""",
    """<body><div class="ad">- One sentence of an advert.</div><article><p>+ Two.</p></article>""",
    """<body><div><a href=1>- Start</a> <a href=2>- Places</a></div><div class="overflow-hidden"><h1>+ A walk by the canal</h1>
    <p>+ The canal was dug two hundred years ago to bring coal to the town, and is now used by anglers and by ducks alone.</p>
    <p>+ It froze last in the winter of the year in which my sister was born.</p></div></body>""",
    """<div><div>+ On paper</div><div>+ Paper was made of rags until the rags ran out, and then of wood, of which there was more at that time.</div>
    <div>+ Old books last longer than new ones for this reason.</div><div>+ Keep them dry.</div></div>""",
    """<p>+ A page may start without a title, as this one does, and come to the point at once in its first sentence.</p>
    <p>+ It may end without a footer too.</p>""",
    """<div><a href=1>- Home</a><a href=2>- Shop</a><a href=3>- Help</a></div><p>+ The shop on the corner has been closed since the owner moved to
    the coast, where the rents are lower and the winters are milder.</p><p>+ Nobody has taken it over so far, it seems.</p>""",
    """<div><p>+ The first train left at five and was always full of people from the mills, who slept until they had to change.</p>
    <p>+ The second was empty.</p><p>+ There never was a third one, whatever the old timetable in the waiting room may have said.</p></div>
    <div><a href=1>- Next story</a></div>""",
    """<p>+ We ate early.</p><p>+ The soup was thin that day, and the bread was old, but there was more than enough of both for all of us.</p>
    <p>+ Then we slept.</p>""",
)
