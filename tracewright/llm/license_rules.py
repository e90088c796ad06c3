"""License signatures: our own rules, written over lower-case words with one space between them.

FAMILIES gives (label, keyword, SPDX spelling, name), each name a regex; three signatures come from every family: the SPDX
tag, the grant ("licensed under the ...") and the bare name.  WORDINGS gives sentences of license texts.
"""

from __future__ import annotations

from dataclasses import dataclass

#: The phrases of the base scan, fixed by the contract.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}

V = "(?: version| v)?"
FAMILIES = [
    ("mit", "mit", "mit", "(?:the )?mit(?: x11)? license"),
    ("mit-0", "mit", "mit 0", "mit(?: license)? 0|mit no attribution(?: license)?"),
    ("apache-1.0", "apache", "apache 1 0", f"apache(?: software)? license{V} 1 0"),
    ("apache-1.1", "apache", "apache 1 1", f"apache(?: software)? license{V} 1 1"),
    ("apache-2.0", "apache", "apache 2 0", f"apache(?: software)?(?: license)?{V} 2(?: 0)?"),
    ("apache", "apache", "apache", "apache(?: software)? license"),
    ("gpl-1.0", "general", "gpl 1 0", f"(?:gnu )?general public license{V} 1"),
    ("gpl-2.0", "general", "gpl 2 0", f"(?:gnu )?general public license{V} 2(?: 0)?"),
    ("gpl-3.0", "general", "gpl 3 0", f"(?:gnu )?general public license{V} 3(?: 0)?"),
    ("gpl", "general", "gpl", "gnu general public license"),
    ("gpl-2.0", "gpl", "gpl 2 0 only", "gnu gpl(?: v2| 2 0| 2)|gplv2|gpl v2"),
    ("gpl-3.0", "gpl", "gpl 3 0 only", "gnu gpl(?: v3| 3 0| 3)|gplv3|gpl v3"),
    ("lgpl-2.0", "library", "lgpl 2 0", f"(?:gnu )?library general public license{V} 2(?: 0)?"),
    ("lgpl-2.1", "lesser", "lgpl 2 1", f"(?:gnu )?lesser general public license{V} 2 1"),
    ("lgpl-3.0", "lesser", "lgpl 3 0", f"(?:gnu )?lesser general public license{V} 3(?: 0)?"),
    ("lgpl", "lesser", "lgpl", "(?:gnu )?lesser general public license"),
    ("lgpl", "lgpl", "lgpl 2 1 only", "gnu lgpl|lgplv2(?: 1)?|lgplv3|lgpl v2 1|lgpl v3"),
    ("agpl-3.0", "affero", "agpl 3 0", f"(?:gnu )?affero general public license{V} 3(?: 0)?"),
    ("agpl", "affero", "agpl", "(?:gnu )?affero general public license"),
    ("agpl", "agpl", "agpl 3 0 only", "gnu agpl|agplv3|agpl v3"),
    ("gfdl", "documentation", "gfdl 1 3", f"(?:gnu )?free documentation license(?:{V} 1 [123])?"),
    ("bsd-2-clause", "bsd", "bsd 2 clause", "(?:simplified|freebsd|2 clause|two clause) bsd(?: license)?|bsd 2 clause(?: license)?"),
    ("bsd-3-clause", "bsd", "bsd 3 clause", "(?:new|modified|revised|3 clause|three clause) bsd(?: license)?|bsd 3 clause(?: license)?"),
    ("bsd-4-clause", "bsd", "bsd 4 clause", "(?:original|old|4 clause|four clause) bsd(?: license)?|bsd 4 clause(?: license)?"),
    ("0bsd", "bsd", "0bsd", "zero clause bsd(?: license)?|bsd zero clause(?: license)?"),
    ("bsd", "bsd", "bsd", "bsd(?: style)? license"),
    ("isc", "isc", "isc", "isc license"),
    ("mpl-1.1", "mozilla", "mpl 1 1", f"mozilla public license{V} 1 1"),
    ("mpl-2.0", "mozilla", "mpl 2 0", f"mozilla public license{V} 2(?: 0)?"),
    ("mpl", "mozilla", "mpl", "mozilla public license"),
    ("epl-1.0", "eclipse", "epl 1 0", f"eclipse public license{V} 1(?: 0)?"),
    ("epl-2.0", "eclipse", "epl 2 0", f"eclipse public license{V} 2(?: 0)?"),
    ("epl", "eclipse", "epl", "eclipse public license"),
    ("edl-1.0", "eclipse", "edl 1 0", f"eclipse distribution license(?:{V} 1 0)?"),
    ("cddl-1.0", "cddl", "cddl 1 0", f"cddl(?:{V} 1 0)?"),
    ("cddl", "development", "cddl 1 1", "common development and distribution license"),
    ("cpl-1.0", "common", "cpl 1 0", f"common public license(?:{V} 1 0)?"),
    ("eupl", "union", "eupl 1 2", f"european union public licen[cs]e(?:{V} 1 [012])?"),
    ("artistic-1.0", "artistic", "artistic 1 0", f"artistic license{V} 1(?: 0)?"),
    ("artistic-2.0", "artistic", "artistic 2 0", f"artistic license{V} 2(?: 0)?"),
    ("artistic", "artistic", "artistic", "artistic license"),
    ("bsl-1.0", "boost", "bsl 1 0", "boost software license(?: version)?(?: 1 0)?"),
    ("busl-1.1", "business", "busl 1 1", "business source license(?: version)?(?: 1 1)?"),
    ("zlib", "zlib", "zlib", "zlib(?: libpng)? license"),
    ("libpng", "libpng", "libpng 2 0", "libpng license"),
    ("unlicense", "unlicense", "unlicense", "the unlicense"),
    ("wtfpl", "wtfpl", "wtfpl", "wtfpl"),
    ("python-2.0", "python", "python 2 0", "python(?: software foundation)? license(?: version)?(?: 2)?"),
    ("php-3.01", "php", "php 3 01", "php license(?: version)?(?: 3 01)?"),
    ("ruby", "ruby", "ruby", "ruby license"),
    ("postgresql", "postgresql", "postgresql", "postgresql licen[cs]e"),
    ("openssl", "openssl", "openssl", "openssl license"),
    ("curl", "curl", "curl", "curl license"),
    ("ofl-1.1", "sil", "ofl 1 1", "sil open font license(?: version)?(?: 1 1)?"),
    ("osl-3.0", "open", "osl 3 0", "open software license(?: version)?(?: 3 0)?"),
    ("afl-3.0", "academic", "afl 3 0", "academic free license(?: version)?(?: 3 0)?"),
    ("ms-pl", "microsoft", "ms pl", "microsoft public license"),
    ("ms-rl", "microsoft", "ms rl", "microsoft reciprocal license"),
    ("ncsa", "ncsa", "ncsa", "(?:university of illinois )?ncsa(?: open source)? license"),
    ("upl-1.0", "universal", "upl 1 0", "universal permissive license(?: version)?(?: 1 0)?"),
    ("vim", "vim", "vim", "vim license"),
    ("w3c", "w3c", "w3c", "w3c(?: software)?(?: notice and)? license"),
    ("ecl-2.0", "educational", "ecl 2 0", "educational community license(?: version)?(?: 2 0)?"),
    ("sspl-1.0", "server", "sspl 1 0", "server side public license(?: version)?(?: 1)?"),
    ("elastic-2.0", "elastic", "elastic 2 0", "elastic license(?: version)?(?: 2 0| 2)?"),
    ("odbl-1.0", "database", "odbl 1 0", "open database license|odbl"),
    ("odc-by", "commons", "odc by 1 0", "open data commons attribution license"),
    ("pddl", "domain", "pddl 1 0", "public domain dedication and license"),
    ("cc0-1.0", "cc0", "cc0 1 0", "cc0(?: 1 0)?(?: universal)?"),
    ("cc-by", "cc", "cc by", "cc by(?: [1234] 0)?"),
    ("cc-by-4.0", "cc", "cc by 4 0", "cc by 4 0"),
    ("cc-by-3.0", "cc", "cc by 3 0", "cc by 3 0"),
    ("cc-by-sa", "cc", "cc by sa", "cc by sa(?: [1234] 0)?"),
    ("cc-by-nc", "cc", "cc by nc", "cc by nc(?: [1234] 0)?"),
    ("cc-by-nd", "cc", "cc by nd", "cc by nd(?: [1234] 0)?"),
    ("cc-by-nc-sa", "cc", "cc by nc sa", "cc by nc sa(?: [1234] 0)?"),
    ("cc-by-nc-nd", "cc", "cc by nc nd", "cc by nc nd(?: [1234] 0)?"),
    ("cc-by", "commons", "cc by 2 0", "creative commons attribution(?: [1234] 0)?(?: international| unported)?(?: license)?"),
    ("cc-by-sa", "commons", "cc by sa 4 0", "creative commons attribution share ?alike(?: [1234] 0)?(?: international| unported)?(?: license)?"),
    ("cc-by-nc", "commons", "cc by nc 4 0", "creative commons attribution non ?commercial(?: [1234] 0)?(?: international| unported)?(?: license)?"),
    ("cc-by-nd", "commons", "cc by nd 4 0", "creative commons attribution no ?derivatives(?: [1234] 0)?(?: license)?"),
    ("cc-by-nc-sa", "commons", "cc by nc sa 4 0", "creative commons attribution non ?commercial share ?alike(?: [1234] 0)?(?: license)?"),
]

WORDINGS = [
    ("mit", "hereby", "permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", "substantial", "shall be included in all copies or substantial portions of the software"),
    ("mit", "noninfringement", "the software is provided as is without warranty of any kind express or implied"),
    ("isc", "hereby", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("bsd", "redistribution", "redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", "redistributions", "redistributions of source code must retain the above copyright notice"),
    ("bsd-3-clause", "endorse", "may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", "advertising", "all advertising materials mentioning features or use of this software must display"),
    ("apache-2.0", "compliance", "you may not use this file except in compliance with the license"),
    ("apache-2.0", "perpetual", "a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("gpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "redistribute", "you can redistribute it and or modify it under the terms of the gnu affero general public license"),
    ("gpl", "merchantability", "without even the implied warranty of merchantability or fitness for a particular purpose"),
    ("mpl-2.0", "subject", "this source code form is subject to the terms of the mozilla public license"),
    ("epl", "accompanying", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("unlicense", "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("cc0-1.0", "waived", "has waived all copyright and related or neighboring rights"),
    ("public-domain", "domain", "(?:dedicated to|released into|placed in|in) the public domain"),
    ("all-rights-reserved", "reserved", "all rights reserved"),
    ("proprietary", "proprietary", "proprietary and confidential"),
    ("proprietary", "unauthorized", "unauthorized (?:copying|distribution|reproduction) (?:of this file )?(?:via any medium )?is strictly prohibited"),
    ("zlib", "altered", "altered source versions must be plainly marked as such"),
    ("bsl-1.0", "boost", "distributed under the boost software license"),
    ("wtfpl", "fuck", "do what the fuck you want to"),
    ("non-commercial", "commercial", "for non ?commercial use only|not for commercial use"),
]

#: What a text must hold for any phrase or signature above to match, in words' beginnings; "_" stands for what parts words.
#: A test holds it against every signature.
GATE = [
    "licen", "unlicense", "spdx", "apache", "mit_0", "mit_no_", "gpl", "lgpl", "agpl", "gnu_gpl", "bsd", "cddl", "wtfpl", "odbl", "cc0", "cc_by",
    "creative_commons", "hereby_granted", "provided_as_is", "redistribut", "merchantability", "unencumbered", "waived_all",
    "public_domain", "rights_reserved", "proprietary_and", "unauthorized_", "altered_source", "advertising_materials", "endorse_or",
    "substantial_portions", "commercial_use", "noncommercial_use", "what_the_fuck",
]

GRANT = "(?:licensed|released|distributed|available|provided|published|covered|shared) (?:under|by) (?:the )?(?:terms of )?(?:the )?"
CONFIDENCE = {3: 1.0, 2: 0.9, 1: 0.75}


@dataclass(frozen=True)
class Signature:
    order: int
    label: str
    keyword: str
    priority: int  # 3: tag or license text, 2: grant, 1: bare name
    regex: str  # over " w1  w2  w3 "


def spaced(words: str) -> str:
    """A signature over single-spaced words as one over words that each have their own spaces."""
    return " (?:" + words.replace(" ?", "\x00").replace(" ", "  ").replace("\x00", "(?:  )?") + ") "


def signatures() -> list[Signature]:
    out: list[tuple[str, str, int, str]] = []
    for label, keyword, spdx, name in FAMILIES:
        out.append((label, "spdx", 3, f"spdx license identifier {spdx}"))
        out.append((label, keyword, 2, f"{GRANT}(?:{name})"))
        out.append((label, keyword, 1, name))
    out += [(label, keyword, 3, words) for label, keyword, words in WORDINGS]
    return [Signature(i, label, keyword, priority, spaced(words)) for i, (label, keyword, priority, words) in enumerate(out)]
