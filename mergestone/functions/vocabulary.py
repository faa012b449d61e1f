"""Word lists and labels of the menu domain."""

# Words that name a kind of thing. A trailing "?" letter group follows regular-expression syntax.
WINE_WORDS = (
    "wines?", "champagne", "prosecco", "cava", "sangria", "mimosa", "moscato", "riesling", "chardonnay", "sauvignon", "cabernet", "merlot", "pinot", "shiraz",
    "syrah", "zinfandel", "malbec", "tempranillo", "grenache", "viognier", "godello", "veltliner", "xinomavro", "colombard", "verdejo", "albarino",
    "garnacha", "sangiovese", "nebbiolo", "chianti", "rioja", "vinho", "rose", "sekt", "sherry", "madeira",
)
WINE_ONLY_WORDS = ("bellini", "spritz(?:er)?", "port", "brut", "sparkling", "red blend", "white blend", "vineyards?", "winery", "wineries", "cellars", "bodegas?", "chateau")
BEER_STYLE_WORDS = ("lagers?", "ipa", "stouts?", "porters?", "pilsners?", "hefeweizen", "weisse", "weizen", "witbier", "saison", "bock", "festbier", "gose", "kolsch", "radler", "shandy")
BEER_MAKER_WORDS = ("brewing", "brewery", "brewer", "brew[ -]?(?:co|hub|pub)", "brauerei", "brouwerij", "brasserie", "cerveceria")
CIDER_WORDS = ("hard cider", "cidery", "perry", "hard seltzer", "mead")
SPIRIT_WORDS = (
    "vodka", "gins?", "rums?", "whiske?y", "bourbon", "scotch", "tequila", "mezcal", "brandy", "cognac", "armagnac", "grappa", "absinthe", "soju", "sake", "schnapps",
    "a[qk]vavit", "ouzo", "pisco", "rye", "kirschwasser", "calvados", "cachaca", "spirits?", "liquor", "distiller(?:y|ies)", "liqueur", "amaretto", "baileys", "kahlua",
    "cointreau", "curacao", "aperol", "campari", "vermouth", "limoncello", "sambuca", "chartreuse", "triple sec", "bitters", "cocktails?", "margarita", "mojito", "martini",
    "old fashioned", "negroni", "daiquiri", "mule", "cosmo(?:politan)?", "punch", "slushy cocktail",
)
NOT_ALCOHOLIC_WORDS = ("non[ -]?alcoholic", "alcohol[ -]free", "virgin", "mocktail")
BREW_WORDS = ("brew(?:ery|eries|ing)", "winery", "wineries", "vineyards?", "cellars", "distiller(?:y|ies)", "barrel[ -]aged", "cask[ -]aged")
SHELLFISH_WORDS = (
    "shrimps?", "prawns?", "crabs?", "lobsters?", "crawfish", "crayfish", "langoustines?", "scallops?", "oysters?", "mussels?", "clams?", "cockles?", "whelks?", "abalone",
    "squid", "calamari", "octopus", "cuttlefish", "escargots?", "snails?", "shellfish", "crustaceans?", "molluscs?", "mollusks?", "seafood",
)
NUT_WORDS = (
    "peanuts?", "almonds?", "cashews?", "walnuts?", "pecans?", "hazelnuts?", "pistachios?", "macadamias?", "pralines?", "marzipan", "nutella", "gianduja", "frangipane",
    "nougat", "amaretto", "pine nuts?", "chestnuts?", "nuts?",
)
HEAT_WORDS = (
    "jalapenos?", "chipotles?", "sriracha", "harissa", "gochujang", "sambal", "cayenne", "habaneros?", "scotch bonnet", "carolina reaper", "poblanos?", "chile de arbol",
    "peri[ -]?peri", "piri[ -]?piri", "serranos?", "chil[ie](?:es|is|s)?", "wasabi", "horseradish", "kimchi", "spicy",
)
SWEET_WORDS = (
    "dessert", "cakes?", "pies?", "tarts?", "cookies?", "brownies?", "mousse", "cheesecake", "gelato", "ice cream", "sorbet", "soft[ -]serve", "sundae", "float", "milk ?shake",
    "pudding", "trifle", "panna cotta", "creme brulee", "flan", "custard", "doughnuts?", "donuts?", "churros?", "waffles?", "strudel", "baklava", "cannoli", "tiramisu",
    "macarons?", "patisserie", "eclair", "profiterole", "bombolon[ei]", "beignets?", "fudge", "toffee", "nougat", "praline", "marshmallow", "marzipan", "slush(?:y|ie)?",
    "frozen lemonade", "hot chocolate", "affogato", "sweetened", "candied", "caramel(?:i[sz]ed)?", "chocolate", "cocoa", "whipped cream", "buttercream", "frosting", "icing",
    "streusel", "crumble", "condensed milk", "dulce de leche", "cajeta", "nutella", "gianduja", "sweet",
)
SAVORY_WORDS = (
    "beef", "pork", "chicken", "lamb", "duck", "turkey", "bacon", "sausage", "brisket", "steak", "ribs?", "chorizo", "jamon", "prosciutto", "schnitzel", "meatballs?", "wings?",
    "shrimps?", "crab", "lobster", "scallops?", "fish", "salmon", "tuna", "anchov(?:y|ies)", "escargot", "cheese", "cheddar", "parmesan", "gouda", "mozzarella", "feta",
    "halloumi", "queso", "brie", "gruyere", "garlic", "onions?", "shallots?", "leeks?", "mushrooms?", "capers?", "truffles?", "olives?", "potatoes?", "fries", "rice",
    "noodles?", "pasta", "gnocchi", "polenta", "risotto", "pretzel", "bread", "dumplings?", "tacos?", "poutine", "soup", "bisque", "stew", "chowder", "slider", "sandwich",
    "wrap", "pizza", "hummus", "aioli", "gravy", "pesto", "chimichurri", "vinaigrette", "savou?ry", "umami",
)
DRINK_ENDINGS = (
    "lager", "ale", "ipa", "stout", "porter", "pilsner", "hefeweizen", "weisse", "witbier", "saison", "bock", "festbier", "gose", "radler", "shandy", "cider", "wine", "champagne",
    "prosecco", "cava", "riesling", "chardonnay", "sauvignon", "cabernet", "merlot", "pinot", "shiraz", "syrah", "zinfandel", "malbec", "viognier", "godello", "veltliner",
    "moscato", "red blend", "white blend", "cocktail", "margarita", "mojito", "martini", "spritz", "mule", "sangria", "mimosa", "bellini", "coffee", "cold brew", "tea", "latte",
    "cappuccino", "espresso", "lemonade", "soda", "cola", "slushy", "shake", "smoothie", "juice", "lassi", "boba", "float", "flight",
)
#: Phrases in which a word of a list does not count for it.
NOT_BEER = ("root beers?", "ginger beers?", "ginger ales?")
NOT_NUTS = ("water chestnuts?",)
NOT_HEAT = ("jamon serranos?",)
NOT_SWEET = ("crab cakes?", "fish cakes?", "onion cakes?", "rice cakes?", "pot pies?", "shepherd's pies?", "cottage pies?", "savou?ry custard", "caramel(?:i[sz]ed)?[ -]?onions?", "sweet[ -]?potato(?:es)?", "sweet[ -]?(?:and|&)[ -]?(?:sour|spicy|hot)")
NOT_SAVORY = ("cream cheese", "chocolate truffles?", "almond truffles?", "olives? oil", "bread pudding")
# Patterns of what a match key leaves out, taken out in this order.
ASIDE = r"\([^)]*\)"
BOILERPLATE = (r"\bbooth\b", r"\bkiosk\b", r"\bmarketplace\b", r"\bmenu\b", r"\bpresented by [\w'&]+(\s[\w'&]+)*", r"\bhosted by [\w'&]+(\s[\w'&]+)*", r"<—.*", r"<-.*", r"click to see.*")
PRICE = r"\$\s*\d+(?:[.,]\d{1,2})?"
SIZE = r"\b\d+(?:\.\d+)?\s*(?:oz|ounces?|ml|cl|lit(?:er|re)s?)\b"
SIGN = r"[^\w\s]"
LEFT_OUT = (ASIDE, "|".join(BOILERPLATE), PRICE, SIZE, SIGN)
TAG_LABELS = {
    "vegan": ("Vegan", "dietary"), "vegetarian": ("Vegetarian", "dietary"), "plant_based": ("Plant-based", "dietary"), "gluten_free": ("Gluten-friendly", "dietary"),
    "contains_alcohol": ("Contains alcohol", "dietary"), "spicy": ("Spicy", "dietary"), "contains_nuts": ("Contains nuts", "dietary"), "contains_shellfish": ("Contains shellfish", "dietary"),
    "sweet": ("Sweet", "flavor"), "savory": ("Savory", "flavor"),
}
