"""The labelled table of the page classifier: small pages, each with the beginnings of the blocks of its main text."""

LABELLED: list[tuple[str, tuple[str, ...]]] = [
    (
        '<html><head><title>Tide tables</title></head><body><nav><ul><li><a href="/">Home</a></li><li><a href="/n">News and weather</a></li><li><a>Sport</a></li></ul></nav>'
        '<div class="ad">Buy two lanterns and get a third one free today.</div>'
        "<article><h1>How tides are predicted</h1><p>Tide tables were once computed by brass machines that added up the motions of the moon and the sun.</p>"
        "<p>Short.</p><p>They were slow, but a good operator could prepare a year of tables for one harbour in a few days, and errors were rare.</p></article>"
        "<footer>&copy; tides.example &middot; All rights of the harbour office are reserved for ever.</footer></body></html>",
        ("How tides", "Tide tables were", "Short.", "They were slow"),
    ),
    (
        '<body><header><a href="/">The Beekeeper</a> A journal of small farms.</header><aside class="sidebar"><h3>Popular</h3><ul><li><a>Ten hives</a></li><li><a>Wax and what to do with it</a></li></ul>'
        "<p>Our writers keep bees in eleven countries and answer letters on Fridays.</p></aside>"
        "<main><h1>Winter feeding</h1><p>Feed before the first frost, and feed more than you think is needed, since a colony eats through the warm days too.</p>"
        "<h2>Sugar or honey</h2><p>Sugar will do.</p><ul><li>Two parts of sugar to one of water.</li><li>Warm, never boiling.</li></ul>"
        '<p>See also the <a href="/wax">notes on wax</a> in last month\'s issue, which this page does not repeat in full.</p></main>'
        '<section class="comments"><h2>Comments</h2><p>Great piece, my grandfather always said the same thing about sugar and frost and he was right.</p><p>I disagree.</p></section>'
        "<footer><p>Written and printed in the valley since the year the bridge was built.</p></footer></body>",
        ("Winter feeding", "Feed before", "Sugar or honey", "Sugar will", "Two parts", "Warm, never", "See also"),
    ),
    (
        '<body><div id="menu"><a>Start</a> <a>Archive</a> <a>Contact</a></div><div class="cookie-notice">We use cookies to remember what you have read. <button>Accept</button></div>'
        '<div class="content"><h1>Old bridges</h1><p>The stone bridge has four arches and carried coaches until the railway came in the middle of the century.</p><p>It stands.</p>'
        '<blockquote>No bridge was ever mourned so long.</blockquote><div class="share">Share this page with friends</div>'
        "<p>Today only walkers use it, and the town pays for one mason to look after the joints each spring.</p></div>"
        '<form action="/s"><label>Search the archive</label><input name="q"><p>Type a word and press the button to search in all years.</p></form>'
        '<div id="footer"><p>Contact the editors by letter, please, and allow a week for an answer.</p></div></body>',
        ("Old bridges", "The stone bridge", "It stands.", "No bridge", "Today only"),
    ),
    (
        "<body><nav><a>One</a><a>Two</a></nav><article><header><p>By our correspondent in the hills</p></header><h1>Snow</h1><p>Snow fell for nine days, and on the tenth the plough could not be found.</p>"
        "<aside><p>Read our guide to ploughs and their care in every season of the year.</p></aside><p>Then it thawed.</p>"
        '<div class="advert"><p>Boots for every winter, now at half the price in all our shops.</p></div><p>The road was open again by Sunday, said the mayor, who had walked it herself.</p>'
        '<div class="related"><h3>More</h3><ul><li><a>Floods of last spring</a></li></ul></div></article><div class="comment-list"><p>Lovely snow this year, we built a house of it.</p></div></body>',
        ("Snow", "Snow fell", "Then it", "The road was"),
    ),
    (
        '<body><div class="topbar"><p>Free delivery on all orders this week</p></div><div><p>There is no article element on this page, but this paragraph is plainly its text, with many words and no links in it at all.</p><p>So it is.</p>'
        "<p>The next paragraph goes on in the same manner, so that the reader and the classifier may both see that it belongs to the first.</p></div>"
        '<div><a>Next page</a> <a>Previous page</a> <a>Index</a></div><div class="newsletter">Leave your address and get a letter from us every month, free of charge.</div></body>',
        ("There is no", "So it is", "The next paragraph"),
    ),
    (
        '<body><ul class="nav"><li><a>A</a></li><li><a>B</a></li></ul><p>A page of old times has its text right in the body, and paragraphs of some length are all that tells it from the rest of the page.</p>'
        "<p>So it was done before there were better ways, and many such pages are still to be found if one looks for them long enough.</p><p><a>Back</a> | <a>Home</a></p><p>Copyright by us.</p></body>",
        ("A page of old", "So it was done"),
    ),
    (
        '<body><nav role="navigation"><ul><li><a>Garden</a></li><li><a>Kitchen</a></li></ul></nav><div class="banner-ad"><p>Seeds, bulbs and tools.</p></div>'
        '<div class="post-body"><h2>Beans</h2><p>Beans.</p><p>Sow them when the hawthorn is in flower; earlier sowings rot.</p><table><tr><td>Runner</td><td>May</td></tr></table><p>Pick often.</p></div>'
        '<div class="promo">Visit our shop by the river, open daily.</div><footer>&copy; garden.example &middot; Grow well.</footer></body>',
        ("Beans", "Sow them", "Runner", "May", "Pick often"),
    ),
    (
        '<body><header><h1>The Daily Lamp</h1><p>All the light that is fit to print.</p></header><article><h1>Lamps go out</h1><p><b>At nine the lamps went out in every street of the old town.<br><p>Nobody knew why.</p>'
        "<p>Children slept on.</p></article><footer>&copy; lamp.example &middot; Printed nightly by hand for the people of the town.</footer>",
        ("Lamps go out", "At nine", "Nobody knew", "Children slept"),
    ),
    (
        "<body><div><p>Weather today is mild at first, with rain by the evening in all the northern parishes and on the hills, and wind from the west that will drop before the morning.</p></div><article><h1>Mills</h1><p>Water mills stood on every stream of the county, and two of them still grind.</p>"
        "<p>The stones came from France.</p></article><div><p>Printed on paper of the county's own making since the old days, and sold in every village that has a shop, an inn or a station where the morning train stops.</p></div></body>",
        ("Mills", "Water mills", "The stones"),
    ),
    ("<body><article><p>One.</p><p>Two words.</p><p>The page ends in the middle of the article, as pages that were cut off do.", ("One.", "Two words.", "The page ends")),
    ("<article><h1>Alone</h1><p>Nothing stands around it.</p></article>", ("Alone", "Nothing stands")),
    (
        "<body><div><p>Subscribers of the evening edition receive the crossword, the tide tables and a letter from the editor with each number of the paper that we print.</p>"
        "<p>Delivery to the islands takes a day longer in winter, for which we ask the patience of all our readers on the outer coast and beyond it.</p></div>"
        "<article><h1>Ferries</h1><p>The new ferry carries forty cars and makes the crossing in half the time of the old one, which will be sold in the spring.</p></article>"
        "<div><p>Letters to the paper should be signed, and may be shortened by the editors where space is wanting, without asking the writer again.</p>"
        "<p>The paper is printed by the same family since its founding, on a press that may be seen by visitors on the first day of each month.</p></div></body>",
        ("Ferries", "The new ferry"),
    ),
]
