"""Fixed values that the engine's results depend on."""

from __future__ import annotations

# Path suffixes of links that are no pages.
FILE_SUFFIXES = (
    ".pdf .png .gif .js .c .css .jpg .jpeg .tif .tiff .epub .zip .tgz .7g .tar .doc .docx .rtf .mp4 .m4v .iso .graph .dta .opus .mp3 .mpv .avi .ogg "
    ".csv .cdf .mkv .c .txt .bmp .gz .py .xls .json .xlsl .xlsx .xz .ppt .ipyn .ipynb .asc .xml .rss .svg"
).split()

# Sites that are never visited, subdomains included.
FORBIDDEN_SITES = (
    "airbnb.com aliexpress.com amazon.ca amazon.co.uk amazon.com amazon.de anonfiles.com archive.org archive.today bandcamp.com hobbyking.com "
    "petitiononline.com ehealthme.com tvtropes.org bing.com bitly.com bloomberg.com brid.gy clickhole.com duckduckgo.com ebay.com ebay.ca etsy.com "
    "facebook.com flickr.com forbes.com ghostarchive.org gist.github.com gofile.io goo.gl goodreads.com google.com googleusercontent.com gutenberg.org "
    "imgur.com imdb.com buzzfeed.com instagram.com justpaste.it last.fm linkedin.com live.com mediafire.com mega.nz nitter.net yandex.com netflix.com "
    "office.com pastebin.com peacocktv.com pintrest.com patreon.com amzn.com amzn.to redbubble.com reddit.com scribd.com snapchat.com society6.com "
    "spoilertv.com spotify.com t.co tiktok.com tinyurl.com tikkun.org metacritic.com github.com twitch.tv tumblr.com twitter.com vimeo.com whatsapp.org "
    "wikidata.org wikipedia.org wp.me yahoo.com youtu.be youtube.com zoom.us thesaurus.com dictionary.com abc7news.com w3.org"
).split()

# What a path in lower case must not contain.
FORBIDDEN_PATHS = (
    "/tag/ /tags/ comment-page- /tagged/ /search/ /category/ /categories/ /collections/ /topic/ /topics/ /spec/ /tr/ /product/ /products/ /comment/ "
    "/opinion/ /opinions/ /newsletter-issue/ /feed/ /feeds/ /user/ /users/ /author/ /columnists/ /people/ /authors/ /interactive/ /member/ /members/ "
    "/profiles/ /news/ /commit/ /solution/ /solutions/ /tree/ /blob/ /listen /vod/ /watch/ /video/ /videos/ /trending/ /politics/20 archive /rss /feed "
    "/download search-results project: portal: category: special: template: talk:"
).split()

# Sites of which only the English edition is visited.
ENGLISH_ONLY_SITES = "wikipedia.org wiktionary.org wikimedia.org".split()

# What a path on a site (or its subdomains) must not contain.
FORBIDDEN_ON_SITE = {
    "github.com": "/commit/ /commits/ /blob/ /edit/ /stargazers /network/members /branches".split(),
    "neocities.org": ["/site/"],
}

# The root sites, whose order is the order of the distance slots.
ROOT_SITES = (
    "https://slatestarcodex.com https://jeremykun.com https://neocities.org https://mitxela.com https://seirdy.one https://coffeeadastra.com "
    "https://spencermounta.in http://worrydream.com http://www.neverendingbooks.org"
).split()

# Thresholds of the ranking dimensions.
ASSET_THRESHOLDS = (100, 1024, 65535, 126000000)
WORD_THRESHOLDS = (5000, 15000, 40000, 500000)
POPULARITY_THRESHOLDS = (1000, 50000, 10000000, 100000000)
UNKNOWN_POPULARITY = 90000000

# The characters at which a title is cut into segments.
TITLE_SEPARATORS = ";:|/—·«»∷><–"
