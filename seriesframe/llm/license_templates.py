"""Template table of license scans: full texts, usual headers and the wordings by which texts name their license."""

from __future__ import annotations

from pathlib import Path

# What stands before a license's name where a text states its license, and names of licenses by identifier.
LEADS = [f"{lead} {the}".strip() for lead in ("under", "terms of", "conditions of", "governed by", "subject to", "covered by") for the in ("", "the")]
#: Where names come in many versions.
FEW_LEADS = ["under", "under the", "under a", "terms of the", "conditions of the"]
NAMES = {
    "MIT": ["MIT License", "MIT licence", "MIT/X11 license", "Expat license"],
    "ISC": ["ISC License", "ISC licence"],
    "Apache-2.0": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0 license", "Apache Software License, Version 2.0", "Apache License v2.0"],
    "BSD-2-Clause": ["2-Clause BSD License", "BSD 2-Clause License", "Simplified BSD License", "FreeBSD License"],
    "BSD-3-Clause": ["3-Clause BSD License", "BSD 3-Clause License", "New BSD License", "Modified BSD License", "Revised BSD License"],
    "LicenseRef-BSD": ["BSD License", "BSD licence", "BSD-style license"],
    "MPL-1.1": ["Mozilla Public License, version 1.1", "Mozilla Public License 1.1", "MPL 1.1"],
    "MPL-2.0": ["Mozilla Public License, v. 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0"],
    "EPL-1.0": ["Eclipse Public License v1.0", "Eclipse Public License 1.0"],
    "EPL-2.0": ["Eclipse Public License v2.0", "Eclipse Public License 2.0", "Eclipse Public License v. 2.0"],
    "BSL-1.0": ["Boost Software License, Version 1.0", "Boost Software License 1.0", "Boost Software License"],
    "Zlib": ["zlib License", "zlib/libpng license"],
    "Unlicense": ["Unlicense", "Unlicense license"],
    "WTFPL": ["Do What The Fuck You Want To Public License", "WTFPL"],
    "Artistic-2.0": ["Artistic License 2.0", "Artistic License, version 2.0"],
    "CC0-1.0": ["CC0 1.0 Universal", "CC0 1.0", "CC0", "Creative Commons Zero"],
}
for _kind, _full in (("GPL", "GNU General Public License"), ("LGPL", "GNU Lesser General Public License"), ("AGPL", "GNU Affero General Public License"), ("GFDL", "GNU Free Documentation License")):
    for _v in {"GPL": ("1", "2", "3"), "LGPL": ("2.1", "3"), "AGPL": ("3",), "GFDL": ("1.1", "1.2", "1.3")}[_kind]:
        _id = f"{_kind}-{_v}" + ("" if "." in _v else ".0")
        NAMES[_id] = [f"{_full}{x}" for x in (f", version {_v}", f" v{_v}", f" {_v}")]
        NAMES[_id] += [f"{_kind}{x}" for x in (f" v{_v}", f"v{_v}", f" {_v}", f"-{_v}", f", version {_v}")] + [f"version {_v} of the {_full}", f"{_full} ({_kind}) version {_v}"]
    NAMES[f"LicenseRef-{_kind}"] = [_full]
for _id, _full in (("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-ND", "Attribution-NoDerivatives"), ("BY-NC", "Attribution-NonCommercial"), ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives")):
    for _v in ("1.0", "2.0", "2.5", "3.0", "4.0"):
        NAMES[f"CC-{_id}-{_v}"] = [f"CC {_id} {_v}", f"CC-{_id} {_v}", f"CC-{_id}-{_v}"] + [f"Creative Commons {_full} {x}" for x in (_v, f"{_v} International", f"{_v} Unported", f"License {_v}")]
        NAMES[f"CC-{_id}-{_v}"] += [f"Creative Commons {_full.replace('-', ' ')} {_v}"] if "-" in _full else []

HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. "
                   "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in "
                   "writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, "
                   "either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this "
                "file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-1.1", "The contents of this file are subject to the Mozilla Public License Version 1.1 (the \"License\"); you may not use this file except in "
                "compliance with the License. You may obtain a copy of the License at http://www.mozilla.org/MPL/"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0. (See accompanying file LICENSE_1_0.txt or copy at http://www.boost.org/LICENSE_1_0.txt)"),
    ("LicenseRef-BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
    ("CC0-1.0", "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the "
                "public domain worldwide. This software is distributed without any warranty."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("ISC", "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is hereby granted"),
    ("BSD-4-Clause", "All advertising materials mentioning features or use of this software must display the following acknowledgement"),
]
#: The version decides here, so these count only whole.
NOTES = [
    (f"{kind}-{v}" + ("" if "." in v else ".0"), f"GNU {full} Public License as published by the Free Software Foundation{by} version {v}")
    for kind, full, versions in (("GPL", "General", "123"), ("LGPL", "Lesser General", ("2.1", "3")), ("LGPL", "Library General", "2"), ("AGPL", "Affero General", "3"))
    for v in versions
    for by in ("", " either")
]


def full_texts() -> list[tuple[str, str]]:
    folder = Path(__file__).parent / "license_texts"
    return [(p.stem, p.read_text(encoding="utf-8")) for p in sorted(folder.glob("*.txt"))]


def wordings() -> list[tuple[str, str]]:
    """Short statements, each lead before each name. One word more or less is another license, so they count only whole."""
    many = ("CC-", "GPL", "LGPL", "AGPL", "GFDL")
    return NOTES + [(i, f"{lead} {name}") for i, names in NAMES.items() for name in names for lead in (FEW_LEADS if i.startswith(many) else LEADS)]
