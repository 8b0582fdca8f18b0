"""Word lists that results depend on."""

from __future__ import annotations

# Stopwords that queries are stripped of.
QUERY_STOPWORDS = """
a an the is are was were be been being has have had of in on at by for with to from and or but not it
its this that these those as if so such do does did can will would should could how why when where which
whose whom also then than some any most many about across around between during into onto over under while
""".split()

# What the search for missing concepts adds to them.
CONCEPT_STOPWORDS = [*QUERY_STOPWORDS, *"""
there here we you they our your their his her section chapter figure table page example note see use using
used one two three four five first second third last next new old both either neither
""".split()]  # fmt: skip

# Names and aliases too general to count as mentions.
MENTION_STOPWORDS = "the and for with that this from are was has have not but all any can its one two new use via".split()

# Words that end a key phrase.
PHRASE_STOPWORDS = """
a an the this that these those such every all any some no another either neither each both
and or but nor yet so for to of in on at by with from as via into onto over under between among across around
during while after before since until than then though although because if unless whether however moreover
thus hence also
be is are was were been being am have has had having do does did doing done
i me my we us our you your he him his she her they them their it its what which who whom whose where when why how
can could may might must shall should will would ought
use used using make made makes see seen saw say said get got go went gone come came take took taken give gave
given set put find found way ways thing things section chapter figure table page example note one two three
four five first second third last next new old many much more most less least few several still even just only
very really quite rather almost always never often sometimes usually perhaps maybe above below again etc
""".split()

# Topic words that don't tell near-duplicate names apart.
TOPIC_STOPWORDS = "consensus causal lock data store system tree model protocol".split()
