"""Licence notices: names, identifiers and grants that licence templates are made from."""

from __future__ import annotations

# SPDX identifiers and the names licences go by.
NAMES = (
    ("apache-2.0", "Apache License, Version 2.0"),
    ("apache-1.1", "Apache Software License, Version 1.1"),
    ("mit", "MIT License"),
    ("mit-0", "MIT No Attribution License"),
    ("isc", "ISC License"),
    ("bsd-2-clause", "BSD 2-Clause License"),
    ("bsd-3-clause", "BSD 3-Clause License"),
    ("0bsd", "BSD Zero Clause License"),
    ("gpl-2.0", "GNU General Public License, version 2"),
    ("gpl-3.0", "GNU General Public License, version 3"),
    ("lgpl-2.1", "GNU Lesser General Public License, version 2.1"),
    ("lgpl-3.0", "GNU Lesser General Public License, version 3"),
    ("agpl-3.0", "GNU Affero General Public License, version 3"),
    ("mpl-1.1", "Mozilla Public License, version 1.1"),
    ("mpl-2.0", "Mozilla Public License, version 2.0"),
    ("epl-1.0", "Eclipse Public License, version 1.0"),
    ("epl-2.0", "Eclipse Public License, version 2.0"),
    ("eupl-1.2", "European Union Public Licence, version 1.2"),
    ("cddl-1.0", "Common Development and Distribution License, version 1.0"),
    ("bsl-1.0", "Boost Software License, version 1.0"),
    ("artistic-2.0", "Artistic License, version 2.0"),
    ("ofl-1.1", "SIL Open Font License, version 1.1"),
    ("upl-1.0", "Universal Permissive License, version 1.0"),
    ("ms-pl", "Microsoft Public License"),
    ("zlib", "zlib License"),
    ("postgresql", "PostgreSQL License"),
    ("unlicense", "The Unlicense"),
    ("wtfpl", "Do What The F*ck You Want To Public License"),
    ("cc0-1.0", "Creative Commons CC0 1.0 Universal Public Domain Dedication"),
    ("cc-by-3.0", "Creative Commons Attribution 3.0 Unported License"),
    ("cc-by-sa-3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
    ("cc-by-4.0", "Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa-4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    ("cc-by-nc-4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    ("cc-by-nd-4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    ("cc-by-nc-sa-4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    ("cc-by-nc-nd-4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    ("odbl-1.0", "Open Data Commons Open Database License, version 1.0"),
)

#: What comes before a licence's name.
LEADS = ("Licensed under the", "Released under the", "This work is licensed under the", "This work is licensed under a")

_OR_LATER = "either version {v} of the License, or (at your option) any later version."
_FREE = "This {thing} is free software{colon} you can redistribute it and/or modify it under the terms of the GNU {name} License as published by the Free Software Foundation"
_REDISTRIBUTE = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_2 = (
    " Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."
    " Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_3 = " Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = " THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS"

# Grants and notices that stand at the head of files, and what tells each from its relatives (parts by |).
GRANTS = (
    ("apache-2.0", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.', "Apache License, Version 2.0"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction.', "to deal in the Software without restriction"),
    ("mit", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.', "to deal in the Software without restriction, including"),
    ("bsl-1.0", 'Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software', "any person or organization"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "in all copies"),
    ("0bsd", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES", "hereby granted. THE SOFTWARE IS PROVIDED AS IS"),
    ("bsd-3-clause", _REDISTRIBUTE + _BSD_2 + _BSD_3, "Neither the name of"),
    ("bsd-2-clause", _REDISTRIBUTE + _BSD_2 + _BSD_END, "provided with the distribution. THIS SOFTWARE IS PROVIDED BY"),
    ("gpl-3.0", f"{_FREE.format(thing='program', colon=':', name='General Public')}, {_OR_LATER.format(v='3')}", "GNU General Public|either version 3 of the License"),
    ("gpl-2.0", f"{_FREE.format(thing='program', colon=';', name='General Public')}; {_OR_LATER.format(v='2')}", "GNU General Public|either version 2 of the License"),
    ("lgpl-2.1", f"{_FREE.format(thing='library', colon=';', name='Lesser General Public')}; {_OR_LATER.format(v='2.1')}", "GNU Lesser General Public|either version 2.1 of the License"),
    ("lgpl-3.0", f"{_FREE.format(thing='library', colon=':', name='Lesser General Public')}, {_OR_LATER.format(v='3')}", "GNU Lesser General Public|either version 3 of the License"),
    ("agpl-3.0", f"{_FREE.format(thing='program', colon=':', name='Affero General Public')}, {_OR_LATER.format(v='3')}", "GNU Affero General Public|either version 3 of the License"),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Mozilla Public License, v. 2.0"),
    ("mpl-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in compliance with the License.", "Mozilla Public License Version 1.1"),
    ("epl-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0", "Eclipse Public License 2.0"),
    ("epl-1.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License v1.0", "Eclipse Public License v1.0"),
    ("unlicense", "This is free and unencumbered software released into the public domain.", "free and unencumbered software"),
    ("zlib", "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "express or implied warranty"),
    ("postgresql", "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted", "without a written agreement"),
    ("ofl-1.1", "This Font Software is licensed under the SIL Open Font License, Version 1.1.", "SIL Open Font License, Version 1.1"),
)

#: Identifiers as SPDX writes them, those of licences that have several last.
SPDX = {
    "apache-1.1": "Apache-1.1", "apache-2.0": "Apache-2.0", "mit": "MIT", "mit-0": "MIT-0", "isc": "ISC", "bsd-2-clause": "BSD-2-Clause",
    "bsd-3-clause": "BSD-3-Clause", "0bsd": "0BSD", "mpl-1.1": "MPL-1.1", "mpl-2.0": "MPL-2.0", "epl-1.0": "EPL-1.0", "epl-2.0": "EPL-2.0",
    "eupl-1.2": "EUPL-1.2", "cddl-1.0": "CDDL-1.0", "bsl-1.0": "BSL-1.0", "artistic-2.0": "Artistic-2.0", "ofl-1.1": "OFL-1.1",
    "upl-1.0": "UPL-1.0", "ms-pl": "MS-PL", "zlib": "Zlib", "postgresql": "PostgreSQL", "unlicense": "Unlicense", "wtfpl": "WTFPL",
    "odbl-1.0": "ODbL-1.0", "cc0-1.0": "CC0-1.0", "cc-by-3.0": "CC-BY-3.0", "cc-by-sa-3.0": "CC-BY-SA-3.0", "cc-by-4.0": "CC-BY-4.0",
    "cc-by-sa-4.0": "CC-BY-SA-4.0", "cc-by-nc-4.0": "CC-BY-NC-4.0", "cc-by-nd-4.0": "CC-BY-ND-4.0", "cc-by-nc-sa-4.0": "CC-BY-NC-SA-4.0",
    "cc-by-nc-nd-4.0": "CC-BY-NC-ND-4.0", "gpl-2.0": "GPL-2.0", "gpl-3.0": "GPL-3.0", "lgpl-2.1": "LGPL-2.1", "lgpl-3.0": "LGPL-3.0",
    "agpl-3.0": "AGPL-3.0",
}
_SUFFIXED = ("gpl-2.0", "gpl-3.0", "lgpl-2.1", "lgpl-3.0", "agpl-3.0")


def templates() -> tuple[tuple[str, str, str], ...]:
    """``(licence, text, key)``: grants, names behind each lead, Creative Commons short names, and identifiers.

    All of a key must stand in a text, part by part: a licence's name with its version and variant, or what only its grant
    says. Longer texts come first, since of equal scores at one place the first template counts."""
    out = [*GRANTS]
    out += [(key, f"{lead} {name}.", name) for key, name in NAMES for lead in LEADS]
    short = {k: SPDX[k].rsplit("-", 1) for k in SPDX if k.startswith("cc-by")}
    named = [(k, f"{'CC ' + name[3:]} {version}") for k, (name, version) in short.items()]
    out += [(k, f"{lead} {name}.", name) for k, name in named for lead in ("Licensed under", "This work is licensed under")]
    tagged = [(k, x) for k, x in SPDX.items()] + [(k, f"{SPDX[k]}-{end}") for k in _SUFFIXED for end in ("only", "or-later")]
    out += [(key, f"SPDX-License-Identifier: {x}", f"Identifier: {x}") for key, x in tagged]
    return tuple(sorted(out, key=lambda t: -len(t[1])))
