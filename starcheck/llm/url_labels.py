"""A small table of labelled URLs to train the filter from. Written by hand for this library."""

# Hosts of pages that sell or lure, and of ordinary ones; each is met on a few kinds of paths.
BLOCKED = [
    "cheap-pills.example.com", "pills-online.example.org", "best-cheap-meds.example.com", "buy-pills.example.net",
    "casino-win.example.com", "online-casino.example.org", "win-casino-bonus.example.com", "poker-win.example.net",
    "spam-farm.example.com", "link-farm.example.org", "content-spam.example.com", "spam-links.example.net",
    "win-prizes.example.com", "cheap-loans.example.org", "payday-loan.example.com", "free-xxx.example.com",
    "cheap-watches.example.org", "slots-jackpot.example.com", "bet-and-win.example.org", "adult-cams.example.com",
    "miracle-diet.example.org", "crypto-doubler.example.com", "replica-bags.example.com", "seo-farm.example.org",
]
ALLOWED = [
    "library.example.org", "news.example.com", "weather.example.org", "museum.example.com", "thehistory.example.org",
    "physics.example.org", "garden.example.com", "recipes.example.com", "travel.example.org", "city.example.com",
    "schools.example.org", "music.example.com", "theatre.example.org", "nature.example.com", "maps.example.org",
    "health.example.org", "sports.example.com", "books.example.org", "stories.example.com", "thinking.example.org",
    "letters.example.com", "onstage.example.org", "ontheroad.example.com", "there.example.org", "handmade.example.com",
    "another.example.org", "stonehenge.example.com", "reading.example.org", "events.example.com", "eastern.example.org",
    "northern.example.com", "entries.example.org", "threads.example.com", "anthem.example.org", "shorelines.example.com",
    "arts.example.org", "tent.example.com", "inland.example.org", "houseplants.example.com", "whale.example.org",
]
FRONTS = ["", "www.", "m.", "blog."]
PATHS = ["/", "/en/10", "/fr/204/", "/de/3030.html", "/es/77"]


def labelled_urls() -> list[tuple[str, str, bool]]:
    """(host, path, is_blocked), each host with two fronts and two paths in turn."""
    rows = []
    for hosts, blocked in ((BLOCKED, True), (ALLOWED, False)):
        for k, host in enumerate(hosts):
            for j in (k, k + 1):
                rows.append((FRONTS[j % len(FRONTS)] + host, PATHS[j % len(PATHS)], blocked))
    return rows
