"""License scans by ordered signature rules.

A text is normalised to its words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+, A-Z lower-cased, with one blank between them, so a
rule is a regex over words.  The rules are written by hand: sentences of license texts, names of licenses with and
without versions, identifiers, and notices.  A rule has one or several keywords and runs only on texts that hold one;
keywords are found in one pass.  Words that grant a license ("licensed under the terms of the ...") right before a
detection belong to it and make it certain.

Rules are ordered by priority.  A detection is suppressed if it lies inside the words of another one of smaller
priority, or of equal priority and greater length; so a version with "or later" suppresses the version, a version the
bare name, and a license's sentence the names in it.  Exact base phrases are never suppressed.

An SPDX expression gives a label for each identifier in it, and -or-later where it says so.  A plus sign is no word,
so GPLv3+ is gpl-3.

The score of a text is the greatest confidence of its detections: 1 for an identifier, grant or sentence, less for a
mention.

Defined cases: a null or empty text has no words, no labels and score 0; rows are scanned each by itself, so repeated
rows and ties give equal results; texts are scanned whole, in time that grows with n log n of their detections; columns
of the input other than doc_id and text are not carried.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from plexloom.llm.common import map_batches, plain_words

# Base phrases and their labels.
BASE = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# The rules, by hand: priority | keywords | label | confidence | regex over words.  {v} in a label stands
# for the version that the regex finds, with a point for a blank.
RULES = r"""
# sentences of license texts
10 | charge | mit | 1.0 | permission is hereby granted free of charge to any person obtaining a copy of this software
10 | charge | mit | 1.0 | permission is hereby granted free of charge to any person obtaining a copy
15 | sublicense | mit | 0.9 | to use copy modify merge publish distribute sublicense and or sell copies of the software
15 | substantial | mit | 0.8 | shall be included in all copies or substantial portions of the software
10 | redistribution | bsd | 1.0 | redistribution and use in source and binary forms with or without modification are permitted
11 | redistributions | bsd | 0.8 | redistributions of source code must retain the above copyright notice
11 | redistributions | bsd | 0.8 | redistributions in binary form must reproduce the above copyright notice
9 | endorse | bsd-3-clause | 1.0 | neither the name of (?:the )?(?:[a-z0-9]+ ){0,8}nor the names of its contributors may be used to endorse or promote products
9 | advertising | bsd-4-clause | 1.0 | all advertising materials mentioning features or use of this software must display the following acknowledge?ment
10 | purpose | isc | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted
10 | purpose | isc | 1.0 | permission to use copy modify and or distribute this software for any purpose
9 | fee | 0bsd | 1.0 | permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided
10 | altered | zlib | 1.0 | altered source versions must be plainly marked as such
10 | origin | zlib | 0.9 | the origin of this software must not be misrepresented
10 | unencumbered | unlicense | 1.0 | this is free and unencumbered software released into the public domain
10 | jurisdictions | unlicense | 0.9 | in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest
10 | fuck | wtfpl | 1.0 | do what the fuck you want to public license
10 | fuck | wtfpl | 0.9 | you just do what the fuck you want to
10 | accompanying | boost-1 | 1.0 | permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license
10 | compliance | apache-2 | 1.0 | licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license
12 | unless | apache-2 | 0.7 | unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis
12 | apache | apache-2 | 0.9 | you may obtain a copy of the license at https? www apache org licenses license 2 0
12 | apache | apache-1.1 | 1.0 | this product includes software developed by the apache software foundation
12 | apache | apache | 0.8 | https? www apache org licenses
10 | mozilla | mpl-2 | 1.0 | this source code form is subject to the terms of the mozilla public license v ?(?:ersion )?2 0
12 | mozilla | mpl-2 | 0.9 | https? mozilla org mpl 2 0
12 | mozilla | mpl-1.1 | 1.0 | the contents of this file are subject to the mozilla public license version 1 1
12 | mozilla | mpl-1 | 1.0 | the contents of this file are subject to the mozilla public license version 1 0
10 | eclipse | epl-2 | 1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?2 0
10 | eclipse | epl-1 | 1.0 | this program and the accompanying materials are made available under the terms of the eclipse public license (?:version |v ?)?1 0
12 | eclipse | epl-2 | 0.9 | https? www eclipse org legal epl 2 0
12 | eclipse | epl-1 | 0.9 | https? www eclipse org legal epl v10 html
12 | common | cddl-1 | 1.0 | the contents of this file are subject to the terms of the common development and distribution license
9 | later | gpl-3-or-later | 1.0 | gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version
9 | later | gpl-2-or-later | 1.0 | gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version
9 | later | gpl-1-or-later | 1.0 | gnu general public license as published by the free software foundation either version 1 (?:of the license )?or at your option any later version
9 | later | lgpl-3-or-later | 1.0 | gnu lesser general public license as published by the free software foundation either version 3 (?:0 )?of the license or at your option any later version
9 | later | lgpl-2.1-or-later | 1.0 | gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version
9 | later | lgpl-2-or-later | 1.0 | gnu (?:library|lesser) general public license as published by the free software foundation either version 2 (?:0 )?of the license or at your option any later version
9 | later | agpl-3-or-later | 1.0 | gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version
9 | foundation | gpl-2 | 1.0 | gnu general public license (?:version 2 )?as published by the free software foundation version 2(?: of the license)?
9 | foundation | gpl-2 | 1.0 | gnu general public license version 2 (?:only )?as published by the free software foundation
9 | foundation | gpl-3 | 1.0 | gnu general public license version 3 (?:only )?as published by the free software foundation
9 | foundation | lgpl-2.1 | 1.0 | gnu lesser general public license version 2 1 (?:only )?as published by the free software foundation
12 | gnu | gpl | 0.8 | you should have received a copy of the gnu general public license along with this program
12 | gnu | lgpl | 0.8 | you should have received a copy of the gnu lesser general public license along with this (?:library|program)
12 | gnu | agpl | 0.8 | you should have received a copy of the gnu affero general public license along with this program
12 | everyone | gpl-text | 0.9 | everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed
12 | gnu | gpl-2 | 0.9 | gnu general public license version 2 june 1991
12 | gnu | gpl-3 | 0.9 | gnu general public license version 3 29 june 2007
12 | gnu | lgpl-2.1 | 0.9 | gnu lesser general public license version 2 1 february 1999
12 | gnu | lgpl-3 | 0.9 | gnu lesser general public license version 3 29 june 2007
12 | gnu | agpl-3 | 0.9 | gnu affero general public license version 3 19 november 2007
12 | documentation | gfdl | 1.0 | permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license
10 | font | ofl-1.1 | 1.0 | this font software is licensed under the sil open font license version 1 1
10 | conditions | artistic | 0.9 | the intent of this document is to state the conditions under which a package may be copied
10 | postgresql | postgresql | 1.0 | postgresql is released under the postgresql license
12 | openssl | openssl | 1.0 | this product includes software developed by the openssl project for use in the openssl toolkit
12 | cryptographic | openssl | 0.9 | this product includes cryptographic software written by eric young
12 | php | php-3.01 | 1.0 | this source file is subject to version 3 01 of the php license
12 | php | php-3 | 1.0 | this source file is subject to version 3 0 of the php license
12 | zope | zpl-2.1 | 1.0 | this software is subject to the provisions of the zope public license version 2 1
12 | holders | w3c | 0.9 | this work is being provided by the copyright holders under the following license
12 | stenberg | curl | 0.9 | copyright and permission notice copyright c (?:19|20)[0-9]{2} (?:[0-9]{4} )?daniel stenberg
12 | libpng | libpng | 1.0 | this code is released under the libpng license
12 | jpeg | ijg | 0.9 | this software is based in part on the work of the independent jpeg group
12 | unicode | unicode | 0.9 | permission is hereby granted free of charge to any person obtaining a copy of the unicode data files
12 | db | sleepycat | 0.9 | information on how to obtain complete source code for the db software
12 | vim | vim | 0.8 | there are no restrictions on distributing unmodified copies of vim
12 | ncsa | ncsa | 0.9 | university of illinois ncsa open source license
12 | beer | beerware | 1.0 | the beer ware license
12 | evil | json | 1.0 | the software shall be used for good not evil
12 | commons | cc | 0.8 | this work is licensed under (?:a|the) creative commons
12 | neighboring | cc0 | 0.9 | has waived all copyright and related or neighboring rights to this work
12 | waived | cc0 | 0.9 | has waived all copyright and related or neighboring rights to
12 | dedicated | cc0 | 0.9 | dedicated (?:the|this) work to the public domain by waiving all of (?:his|her|their) rights
# creative commons
30 | zero | cc0 | 1.0 | creative commons zero(?: v?1 0)?(?: universal)?
40 | cc0 | cc0 | 1.0 | cc0(?: 1 0)?(?: universal)?
30 | creativecommons | cc0 | 1.0 | creativecommons org publicdomain zero 1 0
28 | creativecommons | cc-by-nc-nd-{v} | 1.0 | creativecommons org licenses by nc nd (?P<v>[1-4] [05])
28 | creativecommons | cc-by-nc-sa-{v} | 1.0 | creativecommons org licenses by nc sa (?P<v>[1-4] [05])
29 | creativecommons | cc-by-nc-{v} | 1.0 | creativecommons org licenses by nc (?P<v>[1-4] [05])
29 | creativecommons | cc-by-nd-{v} | 1.0 | creativecommons org licenses by nd (?P<v>[1-4] [05])
29 | creativecommons | cc-by-sa-{v} | 1.0 | creativecommons org licenses by sa (?P<v>[1-4] [05])
30 | creativecommons | cc-by-{v} | 1.0 | creativecommons org licenses by (?P<v>[1-4] [05])
28 | cc | cc-by-nc-nd-{v} | 1.0 | cc by nc nd v?(?P<v>[1-4] [05])
28 | cc | cc-by-nc-sa-{v} | 1.0 | cc by nc sa v?(?P<v>[1-4] [05])
29 | cc | cc-by-nc-{v} | 1.0 | cc by nc v?(?P<v>[1-4] [05])
29 | cc | cc-by-nd-{v} | 1.0 | cc by nd v?(?P<v>[1-4] [05])
29 | cc | cc-by-sa-{v} | 1.0 | cc by sa v?(?P<v>[1-4] [05])
30 | cc | cc-by-{v} | 1.0 | cc by v?(?P<v>[1-4] [05])
53 | cc | cc-by-nc-nd | 0.8 | cc by nc nd
53 | cc | cc-by-nc-sa | 0.8 | cc by nc sa
54 | cc | cc-by-nc | 0.8 | cc by nc
54 | cc | cc-by-nd | 0.8 | cc by nd
54 | cc | cc-by-sa | 0.8 | cc by sa
55 | cc | cc-by | 0.8 | cc by(?: license)?
28 | creative | cc-by-nc-nd-{v} | 1.0 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)? (?P<v>[1-4] [05])
28 | creative | cc-by-nc-sa-{v} | 1.0 | creative commons attribution non ?commercial share ?alike (?P<v>[1-4] [05])
29 | creative | cc-by-nc-{v} | 1.0 | creative commons attribution non ?commercial (?P<v>[1-4] [05])
29 | creative | cc-by-nd-{v} | 1.0 | creative commons attribution no ?deriv(?:ative)?s?(?: works)? (?P<v>[1-4] [05])
29 | creative | cc-by-sa-{v} | 1.0 | creative commons attribution share ?alike (?P<v>[1-4] [05])
30 | creative | cc-by-{v} | 1.0 | creative commons attribution (?P<v>[1-4] [05])
53 | creative | cc-by-nc-nd | 0.8 | creative commons attribution non ?commercial no ?deriv(?:ative)?s?(?: works)?
53 | creative | cc-by-nc-sa | 0.8 | creative commons attribution non ?commercial share ?alike
54 | creative | cc-by-nc | 0.8 | creative commons attribution non ?commercial
54 | creative | cc-by-nd | 0.8 | creative commons attribution no ?deriv(?:ative)?s?(?: works)?
54 | creative | cc-by-sa | 0.8 | creative commons attribution share ?alike
55 | creative | cc-by | 0.8 | creative commons attribution(?: licen[sc]e)?
# gnu licenses by name
25 | gpl | gpl-{v}-or-later | 1.0 | gpl (?:version |ver |v ?)?(?P<v>[123])(?: 0)?(?: licen[sc]e)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
25 | gnu | gpl-{v}-or-later | 1.0 | gnu (?:general public licen[sc]e|gpl)(?: gpl)? (?:version |ver |v ?)?(?P<v>[123])(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
26 | gpl | gpl-{v}-only | 1.0 | gpl (?:version |v ?)?(?P<v>[123])(?: 0)? only
35 | gnu | gpl-{v} | 0.9 | gnu (?:general public licen[sc]e|gpl)(?: gpl)? (?:version |ver |v ?)?(?P<v>[123])(?: 0)?
35 | general | gpl-{v} | 0.9 | general public licen[sc]e (?:version |ver |v ?)(?P<v>[123])(?: 0)?
40 | gpl | gpl-{v} | 0.9 | gpl (?:version |ver |v ?)?(?P<v>[123])(?: 0)?
40 | gplv1 gplv2 gplv3 gpl1 gpl2 gpl3 | gpl-{v} | 0.9 | gplv?(?P<v>[123])(?: 0)?
24 | gplv1 gplv2 gplv3 gpl1 gpl2 gpl3 | gpl-{v}-or-later | 1.0 | gplv?(?P<v>[123])(?: 0)? or (?:any )?(?:later|newer)(?: version)?
60 | gnu | gpl | 0.7 | gnu (?:general public licen[sc]e|gpl)
61 | gpl | gpl | 0.6 | (?:the )?gpl licen[sc]e
25 | lgpl | lgpl-{v}-or-later | 1.0 | lgpl (?:version |ver |v ?)?(?P<v>2 1|2|3)(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
25 | gnu | lgpl-{v}-or-later | 1.0 | gnu (?:lesser general public licen[sc]e|library general public licen[sc]e|lgpl)(?: lgpl)? (?:version |ver |v ?)?(?P<v>2 1|2|3)(?: 0)? or (?:at your option )?(?:any )?(?:later|newer)(?: version)?
35 | gnu | lgpl-{v} | 0.9 | gnu (?:lesser general public licen[sc]e|library general public licen[sc]e|lgpl)(?: lgpl)? (?:version |ver |v ?)?(?P<v>2 1|2|3)(?: 0)?
40 | lgpl | lgpl-{v} | 0.9 | lgpl (?:version |ver |v ?)?(?P<v>2 1|2|3)(?: 0)?
40 | lgplv2 lgplv3 lgpl2 lgpl3 | lgpl-{v} | 0.9 | lgplv?(?P<v>2 1|2|3)(?: 0)?
24 | lgplv2 lgplv3 lgpl2 lgpl3 | lgpl-{v}-or-later | 1.0 | lgplv?(?P<v>2 1|2|3)(?: 0)? or (?:any )?(?:later|newer)(?: version)?
60 | lesser | lgpl | 0.7 | (?:gnu )?lesser general public licen[sc]e
60 | library | lgpl | 0.7 | gnu library general public licen[sc]e
61 | lgpl | lgpl | 0.6 | (?:the )?(?:gnu )?lgpl(?: licen[sc]e)?
25 | agpl | agpl-{v}-or-later | 1.0 | agpl (?:version |v ?)?(?P<v>[13])(?: 0)? or (?:any )?(?:later|newer)(?: version)?
35 | affero | agpl-{v} | 0.9 | (?:gnu )?affero (?:general public licen[sc]e|gpl)(?: agpl)? (?:version |v ?)?(?P<v>[13])(?: 0)?
40 | agpl | agpl-{v} | 0.9 | agpl (?:version |v ?)?(?P<v>[13])(?: 0)?
40 | agplv1 agplv3 agpl1 agpl3 | agpl-{v} | 0.9 | agplv?(?P<v>[13])(?: 0)?
60 | affero | agpl | 0.7 | (?:gnu )?affero (?:general public licen[sc]e|gpl)
61 | agpl | agpl | 0.6 | (?:the )?(?:gnu )?agpl(?: licen[sc]e)?
35 | documentation | gfdl-{v} | 0.9 | gnu free documentation licen[sc]e (?:version |v ?)?(?P<v>1 [123])
60 | documentation | gfdl | 0.7 | gnu free documentation licen[sc]e
# permissive licenses by name
35 | bsd | bsd-{v}-clause | 0.9 | bsd (?P<v>[0234]) clause(?: (?:new |original |simplified |revised )?licen[sc]e)?
35 | clause | bsd-{v}-clause | 0.9 | (?P<v>[0234]) clause bsd(?: licen[sc]e)?
36 | bsd | bsd-3-clause | 0.9 | (?:three clause|new|revised|modified) bsd(?: licen[sc]e)?
36 | bsd | bsd-2-clause | 0.9 | (?:two clause|simplified|freebsd) bsd(?: licen[sc]e)?
36 | bsd | bsd-4-clause | 0.9 | (?:four clause|original) bsd(?: licen[sc]e)?
60 | bsd | bsd | 0.7 | bsd (?:style )?licen[sc]e[ds]?
60 | freebsd | bsd-2-clause | 0.7 | freebsd licen[sc]e
35 | mit | mit-0 | 0.9 | mit no attribution(?: licen[sc]e)?
60 | mit | mit | 0.8 | (?:the )?mit (?:style )?licen[sc]e[ds]?
60 | expat | mit | 0.8 | expat licen[sc]e
61 | x11 | x11 | 0.7 | (?:mit )?x11 licen[sc]e
60 | isc | isc | 0.8 | isc licen[sc]e
35 | apache | apache-{v} | 0.9 | apache (?:software )?licen[sc]e (?:version |v ?)?(?P<v>1 0|1 1|2)(?: 0)?
36 | apache | apache-{v} | 0.9 | apache (?:version |v ?)?(?P<v>1 1|2)(?: 0)?(?: licen[sc]e)?
45 | asl alv2 | apache-2 | 0.7 | (?:asl 2 0|alv2)
60 | apache | apache | 0.7 | apache (?:software |public )?licen[sc]e
60 | zlib | zlib | 0.8 | zlib (?:libpng )?licen[sc]e
60 | unlicense | unlicense | 0.8 | (?:the )?unlicense
60 | wtfpl | wtfpl | 0.9 | wtfpl
35 | boost | boost-1 | 0.9 | boost software licen[sc]e (?:version |v ?)?1 0
60 | boost | boost | 0.7 | boost (?:software )?licen[sc]e
60 | postgresql | postgresql | 0.8 | postgresql licen[sc]e
35 | python | psf-2 | 0.9 | python software foundation licen[sc]e (?:version |v ?)?2
60 | python | psf | 0.7 | (?:python software foundation|psf|python) licen[sc]e
35 | php | php-{v} | 0.9 | php licen[sc]e (?:version |v ?)?(?P<v>3 01|3 0)
60 | php | php | 0.7 | php licen[sc]e
60 | ncsa | ncsa | 0.8 | ncsa (?:open source )?licen[sc]e
35 | zope | zpl-{v} | 0.9 | zope public licen[sc]e (?:version |v ?)?(?P<v>[12] [01])
60 | openssl | openssl | 0.8 | openssl licen[sc]e
35 | academic | afl-{v} | 0.9 | academic free licen[sc]e (?:version |v ?)?(?P<v>1 [12]|2 [01]|3 0)
60 | academic | afl | 0.7 | academic free licen[sc]e
60 | mulan | mulan-psl-2 | 0.8 | mulan (?:permissive software licen[sc]e|psl) v ?2
60 | blue | blueoak-1 | 0.8 | blue oak model licen[sc]e(?: 1 0 0)?
60 | upl | upl-1 | 0.8 | upl (?:version |v ?)?1 0
60 | universal | upl-1 | 0.8 | universal permissive licen[sc]e(?: (?:version |v ?)?1 0)?
60 | ofl | ofl-1.1 | 0.9 | ofl(?: 1 1)?
35 | sil | ofl-{v} | 0.9 | sil open font licen[sc]e (?:ofl )?(?:version |v ?)?(?P<v>1 [01])
60 | sil | ofl | 0.8 | sil open font licen[sc]e
60 | fair | fair | 0.6 | the fair licen[sc]e
60 | ecl | ecl-2 | 0.8 | ecl (?:version |v ?)?2 0
60 | educational | ecl-2 | 0.8 | educational community licen[sc]e(?: (?:version |v ?)?2 0)?
60 | microsoft | ms-pl | 0.9 | microsoft public licen[sc]e(?: ms pl)?
60 | microsoft | ms-rl | 0.9 | microsoft reciprocal licen[sc]e(?: ms rl)?
# reciprocal licenses by name
35 | mozilla | mpl-{v} | 0.9 | mozilla public licen[sc]e(?: mpl)? (?:version |v ?)?(?P<v>1 0|1 1|2)(?: 0)?
40 | mpl | mpl-{v} | 0.9 | mpl (?:version |v ?)?(?P<v>1 0|1 1|2)(?: 0)?
60 | mozilla | mpl | 0.7 | mozilla public licen[sc]e
35 | eclipse | epl-{v} | 0.9 | eclipse public licen[sc]e(?: epl)? (?:version |v ?)?(?P<v>1 0|2)(?: 0)?
40 | epl | epl-{v} | 0.8 | epl (?:version |v ?)?(?P<v>1 0|2 0)
60 | eclipse | epl | 0.7 | eclipse public licen[sc]e
35 | eclipse | edl-1 | 0.9 | eclipse distribution licen[sc]e (?:version |v ?)?1 0
35 | cddl | cddl-{v} | 0.9 | cddl (?:version |v ?)?(?P<v>1 [01])
35 | common | cddl-{v} | 0.9 | common development and distribution licen[sc]e(?: cddl)? (?:version |v ?)?(?P<v>1 [01])
60 | common | cddl | 0.7 | common development and distribution licen[sc]e
35 | common | cpl-1 | 0.9 | common public licen[sc]e (?:version |v ?)?1 0
35 | common | cpal-1 | 0.9 | common public attribution licen[sc]e (?:version |v ?)?1 0
60 | ibm | ipl-1 | 0.8 | ibm public licen[sc]e(?: (?:version |v ?)?1 0)?
35 | artistic | artistic-{v} | 0.9 | artistic licen[sc]e (?:version |v ?)?(?P<v>1 0|2)(?: 0)?
60 | artistic | artistic | 0.7 | artistic licen[sc]e
60 | perl | artistic-or-gpl | 0.8 | (?:under )?the same terms as perl itself
35 | open | osl-{v} | 0.9 | open software licen[sc]e (?:osl )?(?:version |v ?)?(?P<v>[123] [01])
60 | osl | osl | 0.7 | osl (?:version |v ?)?3 0
35 | european | eupl-{v} | 0.9 | european union public licen[sc]e(?: eupl)? (?:version |v ?)?(?P<v>1 [012])
60 | eupl | eupl | 0.7 | eupl(?: v?1 [012])?
60 | sun | spl | 0.8 | sun public licen[sc]e(?: (?:version |v ?)?1 0)?
60 | sun | sissl | 0.8 | sun industry standards source licen[sc]e
60 | apple | apsl-2 | 0.8 | apple public source licen[sc]e(?: (?:version |v ?)?2 0)?
60 | nokia | nokia | 0.8 | nokia open source licen[sc]e
60 | ricoh | ricoh | 0.8 | ricoh source code public licen[sc]e
60 | reciprocal | rpl | 0.8 | reciprocal public licen[sc]e(?: 1 [15])?
60 | sleepycat | sleepycat | 0.8 | sleepycat (?:public |software )?licen[sc]e
60 | simple | simpl-2 | 0.8 | simple public licen[sc]e(?: 2 0)?
60 | qpl | qpl-1 | 0.8 | qpl(?: (?:version |v ?)?1 0)?
60 | q | qpl-1 | 0.8 | (?:the )?q public licen[sc]e
60 | ruby | ruby | 0.7 | ruby licen[sc]e
60 | vim | vim | 0.7 | vim licen[sc]e
60 | latex | lppl-{v} | 0.9 | latex project public licen[sc]e(?: lppl)? (?:version |v ?)?(?P<v>1 [0-3][ac]?)
61 | lppl | lppl | 0.7 | lppl
60 | cecill | cecill-{v} | 0.9 | cecill (?:version |v ?)?(?P<v>1 [01]|2 [01])
61 | cecill | cecill | 0.7 | cecill(?: [bc])?
60 | parity | parity | 0.7 | (?:the )?parity public licen[sc]e
# source-available and proprietary terms
30 | business | busl-1.1 | 0.9 | business source licen[sc]e (?:version |v ?)?1 1
60 | business | busl | 0.8 | business source licen[sc]e
60 | server | sspl-1 | 0.9 | server side public licen[sc]e(?: (?:version |v ?)?1)?
60 | sspl | sspl-1 | 0.8 | sspl
60 | elastic | elastic-2 | 0.9 | elastic licen[sc]e(?: (?:version |v ?)?2 0)?
60 | polyform | polyform | 0.8 | polyform (?:noncommercial|small business|shield|perimeter|strict) licen[sc]e
60 | confluent | confluent | 0.8 | confluent community licen[sc]e
60 | timescale | tsl | 0.8 | timescale licen[sc]e
60 | prosperity | prosperity | 0.8 | prosperity public licen[sc]e
60 | rail | openrail | 0.8 | (?:creativeml |bigscience |bigcode )?open rail(?: ?[msd])?(?: licen[sc]e)?
60 | openrail | openrail | 0.8 | (?:creativeml |bigscience |bigcode )?openrail(?: ?[msd])?(?: licen[sc]e)?
60 | llama | llama | 0.8 | llama (?:2 |3 |3 1 )?community licen[sc]e
60 | odbl | odbl | 0.8 | odbl(?: 1 0)?
60 | database | odbl | 0.8 | open database licen[sc]e(?: odbl)?
60 | odc | odc-by | 0.8 | odc by(?: 1 0)?
60 | commons | pddl | 0.8 | open data commons public domain dedication(?: and licen[sc]e)?
60 | commons | odc-by | 0.8 | open data commons attribution licen[sc]e
30 | clause | commons-clause | 0.9 | commons clause(?: licen[sc]e condition)?
30 | confidential | proprietary | 0.9 | proprietary and confidential
30 | confidential | proprietary | 0.9 | confidential and proprietary
40 | proprietary | proprietary | 0.8 | proprietary (?:software )?licen[sc]e
40 | unauthorized | proprietary | 0.9 | unauthorized (?:copying|reproduction|distribution)(?: or (?:copying|reproduction|distribution))? of this (?:file|software|material|document)
40 | reproduced | proprietary | 0.7 | no part of this (?:publication|book|document|work) may be reproduced
40 | noncommercial | noncommercial | 0.7 | for noncommercial (?:use|purposes) only
40 | commercial | noncommercial | 0.7 | for non commercial (?:use|purposes) only
40 | evaluation | evaluation | 0.7 | for evaluation purposes only
40 | research | research-only | 0.7 | for research (?:use|purposes) only
40 | reserved | proprietary | 0.6 | all rights reserved
# notices
40 | domain | public-domain | 0.9 | (?:released|dedicated|placed|put) (?:in ?)?to the public domain
41 | domain | public-domain | 0.8 | placed in the public domain
45 | domain | public-domain | 0.7 | (?:is|are) (?:hereby )?in the public domain
70 | spdx | spdx | 0.5 | spdx license identifier
70 | warranty | disclaimer | 0.5 | without warranty of any kind
70 | merchantability | disclaimer | 0.5 | (?:implied )?warrant(?:y|ies) of merchantability
70 | warranties | disclaimer | 0.4 | without warranties or conditions of any kind
75 | copyright | copyright | 0.4 | copyright (?:c )?(?:19|20)[0-9]{2}
"""
# SPDX identifiers as words, for expressions after "spdx license identifier".
SPDX = """0bsd|afl 3 0|agpl 3 0|apache 1 1|apache 2 0|artistic 2 0|bsd 2 clause|bsd 3 clause|bsd 4 clause|bsl 1 0|busl 1 1|cc by 3 0|cc by 4 0|cc by nc 4 0|cc by nc nd 4 0|cc by nc sa 4 0|cc by nd 4 0|cc by sa 3 0|cc by sa 4 0|cc0 1 0|cddl 1 0|cddl 1 1|ecl 2 0|epl 1 0|epl 2 0|eupl 1 2|gfdl 1 3|gpl 1 0|gpl 2 0|gpl 3 0|isc|lgpl 2 0|lgpl 2 1|lgpl 3 0|lppl 1 3c|mit|mit 0|mpl 1 1|mpl 2 0|ms pl|mulanpsl 2 0|ncsa|odbl 1 0|ofl 1 1|osl 3 0|php 3 01|postgresql|psf 2 0|python 2 0|sspl 1 0|unlicense|upl 1 0|wtfpl|zlib|zpl 2 1"""


@dataclass(frozen=True)
class Rule:
    priority: int
    keywords: tuple[str, ...]
    label: str
    confidence: float
    pattern: str


def rules() -> list[Rule]:
    """The rules in order of their priority."""
    rows = [[x.strip() for x in line.split("|", 4)] for line in RULES.splitlines() if line.strip() and not line.startswith("#")]
    return sorted((Rule(int(p), tuple(kw.split()), label, float(c), rx) for p, kw, label, c, rx in rows), key=lambda r: r.priority)


@lru_cache(1)
def _compiled() -> tuple[re.Pattern, dict[bytes, list[tuple[Rule, re.Pattern]]], list[tuple[re.Pattern, str]]]:
    by: dict[bytes, list] = {}
    for r in rules():
        rx = re.compile(rb"(?<= )(?:" + r.pattern.encode() + rb")(?= )")
        for kw in r.keywords:
            by.setdefault(kw.encode(), []).append((r, rx))
    keywords = re.compile(rb"(?<= )(?:" + b"|".join(sorted(map(re.escape, by), key=len, reverse=True)) + rb")(?= )")
    return keywords, by, [(re.compile(rb"(?= " + p.encode() + rb" )"), label) for p, label in BASE.items()]


@lru_cache(1)
def _hint() -> re.Pattern:
    """If this isn't found in a text, no keyword and no base phrase occurs in it."""
    short = sorted({kw[:5] for r in rules() for kw in r.keywords} | {"mit", "apache", "cc"}, key=len)
    return re.compile(b" (?:" + b"|".join(re.escape(s.encode()) for s in short if not any(s != t and s.startswith(t) for t in short)) + b")")


_GRANT = re.compile(rb" (?:(?:dual )?licensed|distributed|released|available|published|provided|covered) under (?:a |an |the )?(?:terms (?:and conditions )?of (?:a |an |the )?)?$")
_SPDX = re.compile(rb"(?<= )spdx license identifier((?: (?:or|and|with|only|later|plus|classpath exception 2 0|llvm exception|linux syscall note|" + SPDX.encode() + rb"))+)(?= )")
_SPDX_ID = re.compile(rb"(?<= )(" + b"|".join(sorted(SPDX.encode().split(b"|"), key=len, reverse=True)) + rb")(?= )( or later(?= )| only(?= ))?")
#: Longest text of a grant in bytes.
GRANT_BYTES = 64


def _label(rule: Rule, m: re.Match) -> str:
    return rule.label.replace("{v}", m["v"].decode().replace(" ", ".").removesuffix(".0")) if "{v}" in rule.label else rule.label


class Covered:
    """Intervals kept so far; inside() tells whether one of them covers another.  Starts are known beforehand."""

    def __init__(self, starts: list[int]) -> None:
        self.at = {s: i + 1 for i, s in enumerate(sorted(set(starts)))}
        self.end = [-1] * (len(self.at) + 1)

    def inside(self, start: int, end: int) -> bool:
        i = self.at[start]
        while i:
            if self.end[i] >= end:
                return True
            i &= i - 1
        return False

    def add(self, start: int, end: int) -> None:
        i = self.at[start]
        while i < len(self.end):
            self.end[i] = max(self.end[i], end)
            i += i & -i


def detections(line: bytes, blanks: np.ndarray) -> list[tuple[int, int, str, float]]:
    """Kept detections (first word, word after the last, label, confidence) of a line of words, in order."""
    keywords, by, _ = _compiled()
    found: list[tuple] = []

    def put(priority: int, start: int, end: int, label: str, confidence: float) -> None:
        a, b = (int(x) for x in blanks.searchsorted([start, end]))
        found.append((priority, a - b, a - 1, b, label, confidence))

    seen: set[Rule] = set()
    for kw in set(keywords.findall(line)):
        for rule, rx in by[kw]:
            if rule in seen:
                continue
            seen.add(rule)
            for m in rx.finditer(line):
                low = max(0, m.start() - GRANT_BYTES)
                grant = _GRANT.search(line[low : m.start()]) if rule.priority < 70 else None
                put(rule.priority, low + grant.start() + 1 if grant else m.start(), m.end(), _label(rule, m), 1.0 if grant else rule.confidence)
    for m in _SPDX.finditer(line):
        for x in _SPDX_ID.finditer(line[: m.end() + 1], m.start(1)):
            name = re.sub(r" (?=\d)", ".", x[1].decode()).replace(".", "-", 1).replace(" ", "-") if x[1] not in (b"0bsd",) else "0bsd"
            name = re.sub(r"(?<=\d)\.0$|(?<=-\d)\.0$", "", name)
            put(5, m.start(), x.end(), name + ("-or-later" if x[2] == b" or later" else ""), 1.0)
    kept, covered = [], Covered([d[2] for d in found])
    for d in sorted(found):
        same = kept and kept[-1][:4] == d[:4]  # of equal words and priority all stay
        if same or d[0] == 5 or not covered.inside(d[2], d[3]):
            kept.append(d)
            covered.add(d[2], d[3])
    return sorted({(k[2], k[3], k[4], k[5]) for k in kept})


def scan(text: str | None) -> tuple[int, list[int], list[str], list[str], float, list[tuple[int, int, str]]]:
    """Words, starts of base phrases in order, base labels, all labels, score, and kept detections as (start, end, label)."""
    words = plain_words(text)
    if not words:
        return 0, [], [], [], 0.0, []
    line = b" " + b" ".join(words) + b" "
    if not _hint().search(line):
        return len(words), [], [], [], 0.0, []
    blanks = np.flatnonzero(np.frombuffer(line, np.uint8) == 32)
    places, base_labels = [], set()
    for rx, label in _compiled()[2]:
        for m in rx.finditer(line):
            places.append(int(blanks.searchsorted(m.start())))
            base_labels.add(label)
    kept = detections(line, blanks)
    score = max([1.0] * bool(base_labels) + [k[3] for k in kept], default=0.0)
    return len(words), sorted(places), sorted(base_labels), sorted(base_labels | {k[2] for k in kept}), score, [k[:3] for k in kept]


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score and detections for each row."""

    def run(batches):
        for batch in batches:
            rows = [scan(t) for t in batch.column(1).to_pylist()]
            places = [r[1] for r in rows]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), pa.array([r[0] for r in rows], pa.int64()), pa.array([len(p) for p in places], pa.int64()),
                    pa.array([p[0] if p else None for p in places], pa.int64()), pa.array([p[-1] if p else None for p in places], pa.int64()),
                    pa.array([",".join(r[2]) for r in rows], pa.string()), pa.array([",".join(r[3]) for r in rows], pa.string()), pa.array([r[4] for r in rows], pa.float64()),
                    pa.array([[{"start": a, "end": b, "label": x} for a, b, x in r[5]] for r in rows], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string())]))),
                ],
                names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "detections"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return map_batches(docs.select("doc_id", "text"), run, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,end:long,label:string>>")


#: DuckDB, over the view documents: the columns of base phrases.
ORACLE_BASE = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
p AS (SELECT 'mit' AS label, ['under', 'the', 'mit', 'license'] AS q UNION ALL SELECT 'apache-2', ['apache', 'license', 'version', '2'] UNION ALL SELECT 'cc-by-nc', ['cc', 'by', 'nc']),
f AS (SELECT doc_id, label, i FROM (SELECT doc_id, ws, label, q, unnest(range(0, len(ws))) AS i FROM w, p) WHERE ws[i + 1 : i + len(q)] = q)
SELECT w.doc_id, coalesce(len(any_value(ws)), 0) AS n_words, count(i) AS n_base, min(i) AS first_word, max(i) AS last_word, coalesce(string_agg(DISTINCT label, ',' ORDER BY label), '') AS base_labels
FROM w LEFT JOIN f ON w.doc_id = f.doc_id GROUP BY w.doc_id
"""
