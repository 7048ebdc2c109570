"""Signature rules of licences over canonical text: lower-cased words with one blank between them.

A rule is (label, priority, keywords, expression). Keywords are groups of words; a group's words are alternatives, parted by "|", and every
match of the expression holds a word of each group. The first group is the one that documents are gated by.
"""

from __future__ import annotations

#: Abbreviations in expressions: either spelling, a version's lead-in ("version 2 0", "v2 0", "2 0"), what may follow it, and lead-ins of identifiers.
SHORT = {
    "~L": "licen[cs]e",
    "~V": "(?: v| version| v version)? ?",
    "~O": r"(?: or(?: at your option)? \(?any later(?: version)?| or later| only)?",
    "~I": "(?:spdx license identifier|licen[cs]e|licen[cs]es|licensed under(?: the)?|licen[cs]e is|released under(?: the)?|available under(?: the)?|under the terms of the|distributed under(?: the)?)",
}
LEADS = "license|licence|licenses|licences|licensed|released|available|terms|distributed"

RULES = (
    # Full names
    ("apache-2.0", 60, "apache", r"(?:the )?apache(?: software)? ~L~V2(?: 0)?"),
    ("apache-1.1", 60, "apache", r"(?:the )?apache(?: software)? ~L~V1 1"),
    ("apache-1.0", 60, "apache", r"(?:the )?apache(?: software)? ~L~V1 0"),
    ("apache", 45, "apache license|licence", r"(?:the )?apache(?: software)? ~L"),
    ("mit", 60, "license|licence mit", r"(?:the )?mit(?: x11)? ~L"),
    ("mit", 60, "license|licence expat", r"(?:the )?expat ~L"),
    ("mit", 60, "license|licence x11", r"(?:the )?x11 ~L"),
    ("mit-0", 62, "attribution mit", r"mit no attribution(?: ~L)?"),
    ("mit-advertising", 62, "enlightenment license|licence", r"enlightenment ~L"),
    ("mit-modern", 62, "variant mit", r"mit ~L modern variant"),
    ("gpl-1.0", 60, "gnu general", r"(?:the )?gnu general public ~L~V1(?: 0)?~O"),
    ("gpl-2.0", 60, "gnu general", r"(?:the )?gnu general public ~L~V2(?: 0)?~O"),
    ("gpl-3.0", 60, "gnu general", r"(?:the )?gnu general public ~L~V3(?: 0)?~O"),
    ("gpl", 45, "gnu general license|licence", r"(?:the )?gnu general public ~L"),
    ("gpl", 40, "license|licence general public", r"general public ~L"),
    ("gpl-2.0-classpath", 66, "classpath exception", r"(?:gnu )?classpath(?: linking)? exception"),
    ("gpl-2.0-linux-syscall", 66, "syscall note", r"linux syscall note"),
    ("gpl-bison-exception", 66, "bison exception", r"bison(?: parser)? exception"),
    ("gpl-gcc-exception", 66, "runtime exception gcc", r"gcc runtime library exception(?: 3 1)?"),
    ("gpl-autoconf-exception", 66, "autoconf exception", r"autoconf(?: configure)? exception"),
    ("gpl-font-exception", 66, "font exception gpl", r"gpl (?:with )?font exception"),
    ("lgpl-2.0", 61, "gnu general library", r"(?:the )?gnu library general public ~L~V2(?: 0)?~O"),
    ("lgpl-2.0", 61, "gnu general lesser", r"(?:the )?gnu lesser general public ~L~V2(?: 0)?~O"),
    ("lgpl-2.1", 62, "gnu general lesser", r"(?:the )?gnu lesser general public ~L~V2 1~O"),
    ("lgpl-3.0", 61, "gnu general lesser", r"(?:the )?gnu lesser general public ~L~V3(?: 0)?~O"),
    ("lgpl", 46, "gnu general lesser license|licence", r"(?:the )?gnu lesser general public ~L"),
    ("lgpl", 46, "gnu general library license|licence", r"(?:the )?gnu library general public ~L"),
    ("agpl-3.0", 61, "affero gnu general", r"(?:the )?gnu affero general public ~L~V3(?: 0)?~O"),
    ("agpl-1.0", 61, "affero general", r"affero general public ~L~V1(?: 0)?"),
    ("agpl", 46, "affero general license|licence", r"(?:gnu )?affero general public ~L"),
    ("gfdl-1.1", 60, "gnu documentation free", r"(?:the )?gnu free documentation ~L~V1 1~O"),
    ("gfdl-1.2", 60, "gnu documentation free", r"(?:the )?gnu free documentation ~L~V1 2~O"),
    ("gfdl-1.3", 60, "gnu documentation free", r"(?:the )?gnu free documentation ~L~V1 3~O"),
    ("gfdl", 46, "gnu documentation free license|licence", r"(?:the )?gnu free documentation ~L"),
    ("gnu-all-permissive", 60, "permissive gnu", r"gnu all permissive ~L"),
    ("bsd-4-clause", 60, "bsd clause 4", r"(?:bsd 4 clause|4 clause bsd)(?: ~L)?"),
    ("bsd-4-clause", 60, "bsd original", r"original bsd(?: ~L)?"),
    ("bsd-4-clause", 60, "bsd old", r"old bsd(?: ~L)?"),
    ("bsd-4-clause-uc", 62, "bsd 4 clause uc", r"bsd 4 clause uc"),
    ("bsd-3-clause", 60, "bsd clause 3", r"(?:bsd 3 clause|3 clause bsd)(?: ~L)?"),
    ("bsd-3-clause", 60, "bsd clause three", r"three clause bsd(?: ~L)?"),
    ("bsd-3-clause", 60, "bsd new", r"new bsd(?: ~L)?"),
    ("bsd-3-clause", 60, "bsd modified", r"modified bsd(?: ~L)?"),
    ("bsd-3-clause", 60, "bsd revised", r"revised bsd(?: ~L)?"),
    ("bsd-3-clause-clear", 62, "bsd clear", r"(?:bsd 3 clause clear|clear bsd)(?: ~L)?"),
    ("bsd-3-clause-lbnl", 62, "lawrence berkeley bsd", r"lawrence berkeley national labs bsd variant(?: ~L)?"),
    ("bsd-2-clause", 60, "bsd clause 2", r"(?:bsd 2 clause|2 clause bsd)(?: ~L)?"),
    ("bsd-2-clause", 60, "bsd clause two", r"two clause bsd(?: ~L)?"),
    ("bsd-2-clause", 60, "bsd simplified", r"simplified bsd(?: ~L)?"),
    ("bsd-2-clause", 60, "freebsd", r"(?:the )?freebsd(?: ~L)?"),
    ("bsd-2-clause-patent", 63, "bsd patent", r"bsd 2 clause plus patent(?: ~L)?"),
    ("bsd-2-clause-netbsd", 60, "netbsd license|licence", r"netbsd ~L"),
    ("bsd-1-clause", 60, "bsd clause 1", r"bsd 1 clause(?: ~L)?"),
    ("0bsd", 60, "bsd clause zero", r"zero clause bsd(?: ~L)?"),
    ("0bsd", 60, "bsd clause 0", r"(?:0 clause bsd|bsd 0 clause)(?: ~L)?"),
    ("0bsd", 60, "license|licence free public", r"free public ~L 1 0 0"),
    ("bsd-protection", 60, "bsd protection", r"bsd protection ~L"),
    ("bsd", 45, "bsd license|licence", r"(?:the )?bsd ~L"),
    ("isc", 60, "license|licence isc", r"(?:the )?isc ~L"),
    ("mpl-1.0", 60, "mozilla", r"(?:the )?mozilla public ~L~V1 0"),
    ("mpl-1.1", 60, "mozilla", r"(?:the )?mozilla public ~L~V1 1"),
    ("mpl-2.0", 60, "mozilla", r"(?:the )?mozilla public ~L~V2(?: 0)?"),
    ("mpl", 46, "mozilla license|licence", r"(?:the )?mozilla public ~L"),
    ("netscape-1.0", 60, "netscape", r"netscape public ~L~V1 0"),
    ("netscape-1.1", 60, "netscape", r"netscape public ~L~V1 1"),
    ("epl-1.0", 60, "eclipse public", r"(?:the )?eclipse public ~L~V1 0"),
    ("epl-2.0", 60, "eclipse public", r"(?:the )?eclipse public ~L~V2 0"),
    ("epl", 46, "eclipse public license|licence", r"(?:the )?eclipse public ~L"),
    ("edl-1.0", 60, "eclipse distribution", r"eclipse distribution ~L(?:~V1 0)?"),
    ("cddl-1.0", 60, "distribution development", r"common development and distribution ~L~V1 0"),
    ("cddl-1.1", 60, "distribution development", r"common development and distribution ~L~V1 1"),
    ("cddl", 46, "license|licence distribution development", r"common development and distribution ~L"),
    ("cpl-1.0", 60, "common public", r"common public ~L~V1 0"),
    ("cpal-1.0", 60, "attribution common public", r"common public attribution ~L(?:~V1 0)?"),
    ("ipl-1.0", 60, "ibm public", r"ibm public ~L(?:~V1 0)?"),
    ("eupl-1.0", 60, "european union", r"european union public ~L~V1 0"),
    ("eupl-1.1", 60, "european union", r"european union public ~L~V1 1"),
    ("eupl-1.2", 60, "european union", r"european union public ~L~V1 2"),
    ("artistic-1.0", 60, "artistic", r"(?:the )?artistic ~L~V1 0"),
    ("artistic-2.0", 60, "artistic", r"(?:the )?artistic ~L~V2 0"),
    ("artistic-1.0-perl", 60, "artistic perl", r"perl artistic ~L"),
    ("artistic", 46, "artistic license|licence", r"(?:the )?artistic ~L"),
    ("clarified-artistic", 61, "clarified artistic", r"clarified artistic ~L"),
    ("bsl-1.0", 60, "boost software", r"(?:the )?boost software ~L(?:~V1 0)?"),
    ("busl-1.1", 60, "business source", r"business source ~L(?:~V1 1)?"),
    ("sspl-1.0", 60, "server side public", r"server side public ~L(?:~V1(?: 0)?)?"),
    ("elastic-2.0", 60, "elastic", r"(?:the )?elastic ~L~V2(?: 0)?"),
    ("confluent-1.0", 60, "confluent community", r"confluent community ~L(?:~V1 0)?"),
    ("timescale", 60, "timescale license|licence", r"timescale ~L"),
    ("commons-clause", 60, "clause commons", r"commons clause(?: ~L)?(?: condition v?1 0)?"),
    ("polyform-noncommercial-1.0.0", 60, "polyform noncommercial", r"polyform noncommercial ~L(?: 1 0 0)?"),
    ("polyform-small-business-1.0.0", 60, "polyform small", r"polyform small business ~L(?: 1 0 0)?"),
    ("polyform-shield-1.0.0", 60, "polyform shield", r"polyform shield ~L(?: 1 0 0)?"),
    ("parity-7.0.0", 60, "parity public", r"parity public ~L(?: 7 0 0)?"),
    ("zlib", 60, "license|licence zlib", r"(?:the )?zlib(?: libpng)? ~L"),
    ("libpng", 60, "license|licence libpng", r"(?:the )?libpng ~L"),
    ("libpng-2.0", 62, "png library reference", r"png reference library ~L~V2(?: 0)?"),
    ("unlicense", 60, "unlicense", r"(?:the )?unlicense"),
    ("wtfpl", 60, "wtfpl", r"(?:the )?wtfpl(?: v?2)?"),
    ("wtfpl", 60, "want license|licence public", r"do what the \w+ you want to public ~L"),
    ("python-2.0", 60, "python foundation", r"(?:the )?python software foundation ~L(?:~V2)?"),
    ("python-2.0", 60, "psf", r"(?:the )?psf ~L(?:~V2)?"),
    ("cnri-python", 60, "cnri python", r"cnri(?: open source)?(?: gpl compatible)? (?:~L agreement for )?python(?: ~L)?"),
    ("php-3.0", 60, "php", r"(?:the )?php ~L~V3 0"),
    ("php-3.01", 60, "php", r"(?:the )?php ~L~V3 01"),
    ("zend-2.0", 60, "zend", r"zend ~L~V2 0"),
    ("zpl-2.1", 60, "zope", r"zope public ~L~V2 1"),
    ("zpl-2.0", 60, "zope", r"zope public ~L~V2 0"),
    ("ruby", 60, "ruby license|licence", r"(?:the )?ruby ~L"),
    ("openssl", 60, "openssl license|licence", r"(?:the )?openssl ~L"),
    ("ssleay", 60, "ssleay license|licence", r"(?:the )?(?:original )?ssleay ~L"),
    ("ofl-1.0", 60, "font sil", r"(?:the )?sil open font ~L~V1 0"),
    ("ofl-1.1", 60, "font sil", r"(?:the )?sil open font ~L(?:~V1 1)?"),
    ("odbl-1.0", 60, "database open", r"open (?:data commons open )?database ~L(?: v?1 0)?"),
    ("odc-by-1.0", 60, "attribution commons open data", r"open data commons attribution ~L(?: v?1 0)?"),
    ("pddl-1.0", 60, "dedication domain", r"public domain dedication and ~L(?: v?1 0)?"),
    ("cdla-permissive-1.0", 60, "agreement community data", r"community data ~L agreement permissive(?:~V1 0)?"),
    ("cdla-permissive-2.0", 61, "agreement community data", r"community data ~L agreement permissive~V2 0"),
    ("cdla-sharing-1.0", 60, "agreement community data", r"community data ~L agreement sharing(?:~V1 0)?"),
    ("ogl-uk-3.0", 60, "government open", r"open government ~L(?:~V3(?: 0)?)?"),
    ("dl-de-by-2.0", 60, "datenlizenz deutschland", r"datenlizenz deutschland namensnennung(?: version)? 2 0"),
    ("etalab-2.0", 60, "etalab", r"(?:licence ouverte |open licence )?etalab(?: ~L)?(?: v?2 0)?"),
    ("cecill-1.0", 60, "cecill", r"cecill(?: v ?| version ?| v version ?| )1(?: 0)?"),
    ("cecill-2.0", 60, "cecill", r"cecill(?: v ?| version ?| v version ?| )2 0"),
    ("cecill-2.1", 61, "cecill", r"cecill(?:(?: v ?| version ?| v version ?| )2 1)?"),
    ("cecill-2.1", 61, "cecill2", r"cecill2 1"),
    ("cecill-b", 62, "cecill b", r"cecill b(?: ~L)?"),
    ("cecill-c", 62, "cecill c", r"cecill c(?: ~L)?"),
    ("ms-pl", 60, "microsoft public license|licence", r"microsoft public ~L"),
    ("ms-rl", 60, "reciprocal microsoft", r"microsoft reciprocal ~L"),
    ("ncsa", 60, "ncsa license|licence", r"(?:university of illinois )?ncsa (?:open source )?~L"),
    ("postgresql", 60, "postgresql license|licence", r"(?:the )?postgresql ~L"),
    ("vim", 60, "vim license|licence", r"(?:the )?vim ~L"),
    ("afl-2.1", 60, "academic free", r"academic free ~L~V2 1"),
    ("afl-3.0", 60, "academic free", r"academic free ~L~V3 0"),
    ("osl-1.0", 60, "open software", r"open software ~L~V1 0"),
    ("osl-2.1", 60, "open software", r"open software ~L~V2 1"),
    ("osl-3.0", 60, "open software", r"open software ~L~V3 0"),
    ("ecl-2.0", 60, "educational community", r"educational community ~L~V2 0"),
    ("upl-1.0", 60, "universal permissive", r"universal permissive ~L(?:~V1 0)?"),
    ("ucl-1.0", 60, "upstream compatibility", r"upstream compatibility ~L(?:~V1 0)?"),
    ("qpl-1.0", 60, "public q", r"q public ~L(?:~V1 0)?"),
    ("rpl-1.5", 60, "reciprocal public", r"reciprocal public ~L~V1 5"),
    ("rpsl-1.0", 60, "realnetworks public", r"realnetworks public source ~L(?:~V1 0)?"),
    ("apsl-1.0", 60, "apple public", r"apple public source ~L~V1 0"),
    ("apsl-2.0", 60, "apple public", r"apple public source ~L(?:~V2 0)?"),
    ("sleepycat", 60, "sleepycat license|licence", r"(?:the )?sleepycat ~L"),
    ("sissl", 60, "sun standards industry", r"sun industry standards source ~L(?:~V1 1)?"),
    ("spl-1.0", 60, "sun public", r"sun public ~L~V1 0"),
    ("watcom-1.0", 60, "watcom sybase", r"sybase open watcom public ~L(?:~V1 0)?"),
    ("w3c", 60, "w3c notice", r"w3c software (?:and document )?notice and ~L"),
    ("xnet", 60, "x net license|licence", r"x net ~L"),
    ("lppl-1.3c", 60, "latex project", r"latex project public ~L(?:~V1 3c)?"),
    ("bitstream-vera", 60, "bitstream vera", r"bitstream vera fonts?(?: copyright| ~L)"),
    ("ubuntu-font-1.0", 60, "ubuntu font", r"ubuntu font ~L(?:ce)?(?:~V1 0)?"),
    ("json", 60, "json license|licence", r"(?:the )?json ~L"),
    ("curl", 60, "curl license|licence", r"(?:the )?curl ~L"),
    ("beerware", 60, "beerware", r"(?:the )?beerware ~L(?: revision 42)?"),
    ("beerware", 60, "beer ware", r"(?:the )?beer ware ~L(?: revision 42)?"),
    ("blueoak-1.0.0", 60, "oak blue", r"blue oak model ~L(?: 1 0 0)?"),
    ("hippocratic-2.1", 60, "hippocratic license|licence", r"(?:the )?hippocratic ~L(?: version)?(?: 2 1)?"),
    ("mulan-psl-2.0", 60, "mulan permissive", r"mulan permissive software ~L(?: ?v ?2)?"),
    ("nasa-1.3", 60, "nasa agreement", r"nasa open source agreement(?: 1 3)?"),
    ("ntp", 60, "ntp license|licence", r"(?:the )?ntp ~L"),
    ("tcl", 60, "tcl tk license|licence", r"tcl tk ~L"),
    ("unicode-dfs", 60, "unicode agreement license|licence", r"unicode(?: inc)? ~L agreement(?: data files and software)?"),
    ("eiffel-2.0", 60, "eiffel forum", r"eiffel forum ~L(?:~V2(?: 0)?)?"),
    ("entessa", 60, "entessa public", r"entessa public ~L"),
    ("fair", 60, "fair license|licence", r"(?:the )?fair ~L"),
    ("gsoap", 60, "gsoap public", r"gsoap public ~L"),
    ("intel", 60, "intel open license|licence", r"intel open source ~L"),
    ("lucent-1.02", 60, "lucent public", r"lucent public ~L(?:~V1 02)?"),
    ("miros", 60, "miros license|licence", r"(?:the )?miros ~L"),
    ("motosoto", 60, "motosoto license|licence", r"motosoto open source ~L"),
    ("nokia", 60, "nokia open license|licence", r"nokia open source ~L"),
    ("openldap-2.8", 60, "openldap public", r"openldap public ~L(?:~V2 8)?"),
    ("simple-public-2.0", 60, "simple public", r"simple public ~L~V2 0"),
    ("vovida-1.0", 60, "vovida software", r"vovida software ~L(?:~V1 0)?"),
    ("openrail", 60, "openrail", r"(?:creativeml |bigscience )?openrail(?: m| \+\+ m)?(?: ~L)?"),
    ("openrail", 60, "rail open", r"(?:creativeml |bigscience )?open rail(?: m| \+\+ m)?(?: ~L)?"),
    ("bigscience-bloom-rail-1.0", 62, "bloom rail", r"bigscience bloom rail(?: 1 0| ~L)"),
    ("llama", 60, "community license|licence", r"llama(?: ?\d(?: \d)?)? community ~L(?: agreement)?"),
    ("gemma", 60, "gemma terms", r"gemma terms of use"),
    # Creative Commons
    ("cc0-1.0", 66, "cc0", r"cc0(?: v?1 0)?(?: universal)?"),
    ("cc0-1.0", 66, "creative zero", r"creative commons zero(?: v?1 0)?(?: universal)?"),
    ("cc-pdm-1.0", 66, "mark domain public", r"public domain mark(?: 1 0)?"),
    ("cc-by-1.0", 65, "cc by", r"cc by ~Y1 0"),
    ("cc-by-2.0", 65, "cc by", r"cc by ~Y2 0"),
    ("cc-by-2.5", 65, "cc by", r"cc by ~Y2 5"),
    ("cc-by-3.0", 65, "cc by", r"cc by ~Y3 0~U"),
    ("cc-by-4.0", 65, "cc by", r"cc by ~Y4 0~U"),
    ("cc-by-sa-1.0", 65, "cc sa", r"cc by sa ~Y1 0"),
    ("cc-by-sa-2.0", 65, "cc sa", r"cc by sa ~Y2 0"),
    ("cc-by-sa-2.5", 65, "cc sa", r"cc by sa ~Y2 5"),
    ("cc-by-sa-3.0", 65, "cc sa", r"cc by sa ~Y3 0~U"),
    ("cc-by-sa-4.0", 65, "cc sa", r"cc by sa ~Y4 0~U"),
    ("cc-by-nd-2.0", 65, "cc nd", r"cc by nd ~Y2 0"),
    ("cc-by-nd-3.0", 65, "cc nd", r"cc by nd ~Y3 0~U"),
    ("cc-by-nd-4.0", 65, "cc nd", r"cc by nd ~Y4 0~U"),
    ("cc-by-nc-2.0", 65, "cc nc", r"cc by nc ~Y2 0"),
    ("cc-by-nc-3.0", 65, "cc nc", r"cc by nc ~Y3 0~U"),
    ("cc-by-nc-4.0", 65, "cc nc", r"cc by nc ~Y4 0~U"),
    ("cc-by-nc-sa-2.0", 65, "cc nc sa", r"cc by nc sa ~Y2 0"),
    ("cc-by-nc-sa-3.0", 65, "cc nc sa", r"cc by nc sa ~Y3 0~U"),
    ("cc-by-nc-sa-4.0", 65, "cc nc sa", r"cc by nc sa ~Y4 0~U"),
    ("cc-by-nc-nd-2.0", 65, "cc nc nd", r"cc by nc nd ~Y2 0"),
    ("cc-by-nc-nd-3.0", 65, "cc nc nd", r"cc by nc nd ~Y3 0~U"),
    ("cc-by-nc-nd-4.0", 65, "cc nc nd", r"cc by nc nd ~Y4 0~U"),
    ("cc-by", 55, "cc by", r"cc by"),
    ("cc-by-sa", 56, "cc sa", r"cc by sa"),
    ("cc-by-nd", 56, "cc nd", r"cc by nd"),
    ("cc-by-nc", 56, "cc nc", r"cc by nc"),
    ("cc-by-nc-sa", 57, "cc nc sa", r"cc by nc sa"),
    ("cc-by-nc-nd", 57, "cc nc nd", r"cc by nc nd"),
    ("cc-by-3.0", 65, "creative attribution", r"creative commons attribution~X3 0~U"),
    ("cc-by-4.0", 65, "creative attribution", r"creative commons attribution~X4 0~U"),
    ("cc-by-sa-3.0", 65, "creative attribution", r"creative commons attribution share ?alike~X3 0~U"),
    ("cc-by-sa-4.0", 65, "creative attribution", r"creative commons attribution share ?alike~X4 0~U"),
    ("cc-by-nd-4.0", 65, "creative attribution", r"creative commons attribution no ?deriv(?:ative)?s~X4 0~U"),
    ("cc-by-nc-3.0", 65, "creative attribution", r"creative commons attribution non ?commercial~X3 0~U"),
    ("cc-by-nc-4.0", 65, "creative attribution", r"creative commons attribution non ?commercial~X4 0~U"),
    ("cc-by-nc-sa-3.0", 65, "creative attribution", r"creative commons attribution non ?commercial share ?alike~X3 0~U"),
    ("cc-by-nc-sa-4.0", 65, "creative attribution", r"creative commons attribution non ?commercial share ?alike~X4 0~U"),
    ("cc-by-nc-nd-4.0", 65, "creative attribution", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s~X4 0~U"),
    ("cc-by", 55, "creative attribution", r"creative commons attribution(?: ~L)?"),
    ("cc-by-sa", 56, "creative attribution", r"creative commons attribution share ?alike(?: ~L)?"),
    ("cc-by-nd", 56, "creative attribution", r"creative commons attribution no ?deriv(?:ative)?s(?: ~L)?"),
    ("cc-by-nc", 56, "creative attribution", r"creative commons attribution non ?commercial(?: ~L)?"),
    ("cc-by-nc-sa", 57, "creative attribution", r"creative commons attribution non ?commercial share ?alike(?: ~L)?"),
    ("cc-by-nc-nd", 57, "creative attribution", r"creative commons attribution non ?commercial no ?deriv(?:ative)?s(?: ~L)?"),
    ("cc-by", 64, "creativecommons by", r"creativecommons org licenses by \d \d"),
    ("cc-by-sa", 64, "creativecommons sa", r"creativecommons org licenses by sa \d \d"),
    ("cc-by-nd", 64, "creativecommons nd", r"creativecommons org licenses by nd \d \d"),
    ("cc-by-nc", 64, "creativecommons nc", r"creativecommons org licenses by nc \d \d"),
    ("cc-by-nc-sa", 64, "creativecommons nc sa", r"creativecommons org licenses by nc sa \d \d"),
    ("cc-by-nc-nd", 64, "creativecommons nc nd", r"creativecommons org licenses by nc nd \d \d"),
    ("cc0-1.0", 64, "creativecommons zero", r"creativecommons org publicdomain zero 1 0"),
    ("cc-pdm-1.0", 64, "creativecommons mark", r"creativecommons org publicdomain mark 1 0"),
    # Identifiers behind a lead-in
    ("mit", 58, f"{LEADS} mit", r"~I mit"),
    ("mit-0", 59, f"{LEADS} mit 0", r"~I mit 0"),
    ("apache-2.0", 58, f"{LEADS} apache|apache2", r"~I apache(?: v)? ?2(?: 0)?"),
    ("apache-2.0", 58, f"{LEADS} apache2|asl", r"~I (?:apache2(?: 0)?|asl 2 0)"),
    ("apache-1.1", 59, f"{LEADS} apache 1", r"~I apache 1 1"),
    ("gpl-2.0", 58, f"{LEADS} gpl|gpl2", r"~I (?:gnu )?gpl(?: v| version)? ?2(?: 0)?~O"),
    ("gpl-2.0", 58, f"{LEADS} gplv2|gpl2", r"~I (?:gnu )?(?:gplv2|gpl2)~O"),
    ("gpl-3.0", 58, f"{LEADS} gpl|gpl3", r"~I (?:gnu )?gpl(?: v| version)? ?3(?: 0)?~O"),
    ("gpl-3.0", 58, f"{LEADS} gplv3|gpl3", r"~I (?:gnu )?(?:gplv3|gpl3)~O"),
    ("lgpl-2.0", 58, f"{LEADS} lgpl|lgpl2", r"~I lgpl(?: v)? ?2 0~O"),
    ("lgpl-2.1", 58, f"{LEADS} lgpl|lgpl2", r"~I lgpl(?: v)? ?2 1~O"),
    ("lgpl-2.1", 58, f"{LEADS} lgplv2", r"~I lgplv2 1~O"),
    ("lgpl-3.0", 58, f"{LEADS} lgpl|lgpl3", r"~I lgpl(?: v)? ?3(?: 0)?~O"),
    ("lgpl-3.0", 58, f"{LEADS} lgplv3", r"~I lgplv3~O"),
    ("agpl-3.0", 58, f"{LEADS} agpl|agpl3", r"~I agpl(?: v)? ?3(?: 0)?~O"),
    ("agpl-3.0", 58, f"{LEADS} agplv3", r"~I agplv3~O"),
    ("bsd-2-clause", 59, f"{LEADS} bsd clause 2", r"~I bsd 2 clause"),
    ("bsd-3-clause", 59, f"{LEADS} bsd clause 3", r"~I bsd 3 clause"),
    ("bsd-4-clause", 59, f"{LEADS} bsd clause 4", r"~I bsd 4 clause"),
    ("0bsd", 59, f"{LEADS} 0bsd", r"~I 0bsd"),
    ("bsd", 50, f"{LEADS} bsd", r"~I bsd"),
    ("isc", 58, f"{LEADS} isc", r"~I isc"),
    ("mpl-1.1", 58, f"{LEADS} mpl|mpl1", r"~I mpl(?: v)? ?1 1"),
    ("mpl-2.0", 58, f"{LEADS} mpl|mpl2", r"~I mpl(?: v)? ?2(?: 0)?"),
    ("mpl-2.0", 58, f"{LEADS} mplv2", r"~I mplv2(?: 0)?"),
    ("epl-1.0", 58, f"{LEADS} epl|epl1", r"~I epl(?: v)? ?1 0"),
    ("epl-2.0", 58, f"{LEADS} epl|epl2", r"~I epl(?: v)? ?2 0"),
    ("cddl-1.0", 58, f"{LEADS} cddl|cddl1", r"~I cddl(?: v)? ?1 0"),
    ("cddl-1.1", 58, f"{LEADS} cddl|cddl1", r"~I cddl(?: v)? ?1 1"),
    ("cpl-1.0", 58, f"{LEADS} cpl|cpl1", r"~I cpl(?: v)? ?1 0"),
    ("eupl-1.2", 58, f"{LEADS} eupl|eupl1", r"~I eupl(?: v)? ?1 2"),
    ("artistic-2.0", 58, f"{LEADS} artistic", r"~I artistic 2 0"),
    ("bsl-1.0", 58, f"{LEADS} bsl", r"~I bsl 1 0"),
    ("busl-1.1", 58, f"{LEADS} busl", r"~I busl 1 1"),
    ("sspl-1.0", 58, f"{LEADS} sspl|sspl1", r"~I sspl(?: v)? ?1(?: 0)?"),
    ("zlib", 58, f"{LEADS} zlib", r"~I zlib"),
    ("postgresql", 58, f"{LEADS} postgresql", r"~I postgresql"),
    ("ncsa", 58, f"{LEADS} ncsa", r"~I ncsa"),
    ("ofl-1.1", 58, f"{LEADS} ofl|ofl1", r"~I ofl(?: v)? ?1 1"),
    ("odbl-1.0", 58, f"{LEADS} odbl|odbl1", r"~I odbl(?: v)? ?1 0"),
    ("pddl-1.0", 58, f"{LEADS} pddl|pddl1", r"~I pddl(?: v)? ?1 0"),
    ("gfdl-1.3", 58, f"{LEADS} gfdl|gfdl1", r"~I gfdl(?: v)? ?1 3~O"),
    ("ms-pl", 58, f"{LEADS} ms pl", r"~I ms pl"),
    ("php-3.01", 58, f"{LEADS} php", r"~I php 3 01"),
    ("python-2.0", 58, f"{LEADS} python", r"~I python 2 0"),
    ("unlicense", 61, "unlicense", r"~I (?:the )?unlicense"),
    ("cc0-1.0", 67, f"{LEADS} cc0", r"~I cc0 1 0"),
    # Sentences of notices
    ("mit", 30, "granted permission obtaining", r"permission is hereby granted free of charge to any person obtaining a copy"),
    ("mit", 25, "notice permission substantial", r"the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit-0", 28, "sublicense|merge restriction deal", r"to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute"),
    ("isc", 30, "fee permission purpose", r"permission to use copy modify and(?: or)? distribute this software for any purpose with or without fee"),
    ("bsd", 30, "redistribution binary permitted", r"redistribution and use in source and binary forms with or without modification are permitted"),
    ("bsd", 25, "redistributions retain notice", r"redistributions of source code must retain the above copyright notice"),
    ("bsd", 25, "redistributions reproduce binary", r"redistributions in binary form must reproduce the above copyright notice"),
    ("bsd-3-clause", 40, "endorse promote neither", r"neither the name of [\w ]{1,80} may be used to endorse or promote products"),
    ("bsd-4-clause", 40, "advertising materials display", r"all advertising materials mentioning features or use of this software must display"),
    ("gpl", 30, "redistribute gnu modify", r"you can redistribute it and or modify it under the terms of the gnu"),
    ("gpl", 20, "foundation published software", r"as published by the free software foundation"),
    ("gpl", 20, "merchantability hope fitness", r"in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness"),
    ("gpl", 20, "gnu received copy", r"you should have received a copy of the gnu general public ~L"),
    ("lgpl", 21, "gnu received copy lesser", r"you should have received a copy of the gnu lesser general public ~L"),
    ("agpl", 21, "gnu received copy affero", r"you should have received a copy of the gnu affero general public ~L"),
    ("apache-2.0", 63, "apache licensed except", r"licensed under the apache ~L version 2 0 the ~L you may not use this file except"),
    ("apache-2.0", 40, "apache licenses 2", r"www apache org licenses license 2 0"),
    ("apache-2.0", 25, "conditions kind warranties", r"without warranties or conditions of any kind either express or implied"),
    ("apache", 30, "apache contributor foundation", r"licensed to the apache software foundation asf under one or more contributor ~L agreements"),
    ("mpl-2.0", 40, "mozilla form source", r"this source code form is subject to the terms of the mozilla public ~L"),
    ("mpl-2.0", 35, "incompatible secondary", r"incompatible with secondary licenses"),
    ("mpl", 30, "mozilla mpl", r"(?:www )?mozilla org mpl(?: 2 0)?"),
    ("epl-2.0", 35, "eclipse legal", r"www eclipse org legal epl(?: 2 0| v20)"),
    ("epl-1.0", 35, "eclipse legal", r"www eclipse org legal epl v10"),
    ("gpl", 35, "gnu licenses org", r"(?:www )?gnu org licenses(?: gpl(?: \d \d)?)?"),
    ("mit", 35, "opensource mit", r"opensource org licenses mit(?: license)?"),
    ("bsd", 35, "opensource bsd", r"opensource org licenses bsd(?: license| 2 clause| 3 clause)?"),
    ("ofl-1.1", 35, "sil scripts", r"scripts sil org ofl"),
    ("zlib", 30, "implied warranty event", r"this software is provided as is without any express or implied warranty in no event will the authors"),
    ("zlib", 28, "misrepresented origin", r"the origin of this software must not be misrepresented"),
    ("bsl-1.0", 30, "entire statement notices", r"copyright notices in the software and this entire statement including the above ~L grant"),
    ("unlicense", 40, "unencumbered", r"this is free and unencumbered software released into the public domain"),
    ("unlicense", 40, "unlicense org", r"unlicense org"),
    ("wtfpl", 30, "want just", r"you just do what the \w+ you want to"),
    ("public-domain", 25, "domain placed|released|dedicated", r"(?:placed|released|dedicated) (?:in|into|to) the public domain"),
    ("public-domain", 25, "domain waived|relinquished|abandoned", r"(?:waived|relinquished|abandoned)(?: all)?(?: copyright)?(?: and)?(?: related)?(?: rights)? (?:in|into|to) the public domain"),
    ("public-domain", 22, "domain public this", r"this (?:work|file|software|code|text) is in the public domain"),
    ("public-domain", 22, "domain copyrighted", r"not copyrighted (?:and )?(?:is )?in the public domain"),
    ("us-government", 25, "government work", r"work of the (?:united states|us|u s) government"),
    ("crown-copyright", 20, "crown copyright", r"crown copyright"),
    ("proprietary", 10, "reserved rights", r"all rights reserved"),
    ("proprietary", 15, "proprietary confidential", r"proprietary and confidential"),
    ("proprietary", 15, "confidential proprietary", r"confidential and proprietary"),
    ("proprietary", 15, "unauthorized prohibited", r"unauthorized (?:copying|use|reproduction|distribution)[\w ]{0,60} (?:is )?strictly prohibited"),
    ("proprietary", 15, "reproduced permission written", r"may not be reproduced(?: [\w ]{0,80})? without(?: the)?(?: prior)?(?: express)? written permission"),
    ("proprietary", 15, "secrets trade", r"contains trade secrets"),
    ("proprietary", 12, "eula", r"(?:this )?eula"),
    ("proprietary", 15, "end user agreement license|licence", r"end user ~L agreement"),
    ("proprietary", 15, "redistribution permitted not", r"redistribution (?:is )?not permitted"),
    ("non-commercial", 18, "commercial|noncommercial only", r"for non ?commercial (?:use|purposes) only"),
    ("non-commercial", 18, "commercial prohibited", r"commercial use (?:is )?(?:strictly )?prohibited"),
    ("research-only", 18, "research only", r"for research (?:use|purposes) only"),
    ("research-only", 18, "academic only", r"for academic (?:use|purposes) only"),
    ("personal-use", 18, "personal only", r"for personal(?: and)?(?: non ?commercial)? use only"),
    ("no-derivatives", 16, "derivative permitted works", r"no derivative works(?: are)? permitted"),
    ("attribution", 14, "attribution required", r"attribution (?:is )?required"),
    ("attribution", 14, "credit author|source", r"credit must be given to the (?:author|source)"),
    ("share-alike", 14, "alike share", r"share alike"),
    ("copyleft", 14, "copyleft", r"copyleft"),
    ("free-art-1.3", 40, "art free", r"free art ~L(?: 1 3)?"),
    ("dual-licensed", 12, "dual|dually licensed", r"(?:dual|dually) licensed under"),
    ("patent-grant", 12, "patent royalty", r"royalty free(?: irrevocable)? patent ~L"),
    ("no-warranty", 5, "warranty kind", r"without warranty of any kind"),
    ("no-warranty", 5, "as warranty", r"provided as is without(?: any)? warranty"),
    ("no-liability", 5, "liable holders|authors|damages", r"in no event shall the (?:authors|copyright holders)(?: or copyright holders)? be liable"),
    ("permissive", 8, "permission granted", r"permission is granted to (?:copy|use|distribute|reproduce)"),
    ("permissive", 8, "freely may", r"may be freely (?:copied|distributed|used|reproduced)(?: and distributed)?"),
    ("copyright", 5, "copyright", r"copyright(?: c)? (?:19|20)\d\d"),
    ("copyright", 4, "copyright holder|holders", r"copyright holders?"),
)
#: Between a part of a Creative Commons name and its version.
SHORT |= {"~Y": "(?:licen[cs]e )?(?:version |v )?", "~X": "(?: licen[cs]e)?(?: version| v)? ", "~U": "(?: international| unported)?"}
